"""A run's configuration and the outputs it should have, as DataFrames.

Chunk files, job lists, submission and monitoring of a batch queue have no counterpart: the outputs that are missing
are the rows of an anti join, and Spark schedules the work.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import grids
from mosaiq.operators import results

REQUIRED = ("run_name", "input", "output", "steps")
METHODS = ("leiden", "phenograph", "kmeans", "lda", "preexisting")


@dataclass
class MethodSpec:
    """One clustering method of a run."""

    method: str
    data_types: list[str] = field(default_factory=list)
    distances: list[str] = field(default_factory=lambda: ["correlation"])
    n_resolutions: int = 50
    log_min: float = -1.0
    log_max: float = 2.5
    levels: list[str] = field(default_factory=list)
    k_values: list[int] = field(default_factory=list)
    k_jaccard: int = 30


@dataclass
class RunConfig:
    """A checked configuration. Unknown methods, missing keys and data types without a feature raise ValueError."""

    raw: dict

    def __post_init__(self) -> None:
        if lacking := [k for k in REQUIRED if k not in self.raw]:
            raise ValueError(f"configuration lacks {lacking}")
        self.run_name = self.raw["run_name"]
        self.steps = self.raw["steps"]
        graph = self.steps.get("graphs", {})
        for m in self.methods:
            if m.method not in METHODS:
                raise ValueError(f"unknown method: {m.method}")
            wrong = set(m.distances) - set(graph.get("distances", m.distances))
            if m.method in ("leiden", "phenograph") and wrong:
                raise ValueError(f"{m.method} needs graphs for distances {sorted(wrong)}")

    @classmethod
    def from_yaml(cls, path: str) -> RunConfig:
        import yaml

        with open(path) as f:
            return cls(yaml.safe_load(f))

    @property
    def base_features(self) -> list[str]:
        s = self.steps.get("features", {})
        out = list(s.get("types", []))
        lf = s.get("local_frequency", {})
        for k in lf.get("k_values", []):
            for w in lf.get("weighted", [False]):
                out.append(f"localfreq{'_w' if w else ''}_k{k}")
        return list(dict.fromkeys(out))

    @property
    def dependencies(self) -> dict[str, str]:
        """Derived features with the base feature each is made from."""
        out = {}
        for spec in self.steps.get("features", {}).get("derived", []):
            ns = spec.get("n_components", 50)
            for src in matching(self.base_features, spec.get("sources", "all")):
                for n in ns if isinstance(ns, list) else [ns]:
                    parts = src.split("_")
                    at = (2 if parts[1:2] == ["w"] else 1) if parts[0] == "localfreq" else max(len(parts) - 1, 0)
                    out["_".join([*parts[:at], f"pca{n}", *parts[at:]])] = src
        return out

    @property
    def features(self) -> list[str]:
        return [*self.base_features, *self.dependencies]

    @property
    def methods(self) -> list[MethodSpec]:
        out = []
        for m in self.steps.get("clustering", {}).get("methods", []):
            spec = MethodSpec(**{k: v for k, v in m.items() if k in MethodSpec.__dataclass_fields__})
            spec.data_types = matching(self.features, m.get("data_types", "all"))
            out.append(spec)
        return out

    @property
    def phenographs(self) -> list[tuple[str, str, int]]:
        """Each (data type, distance, k_jaccard) for which a Jaccard graph is needed, once."""
        return list(dict.fromkeys((dt, d, m.k_jaccard) for m in self.methods if m.method == "phenograph" for dt in m.data_types for d in m.distances))

    @property
    def graph_k(self) -> int:
        return int(self.steps.get("graphs", {}).get("k", 15))

    @property
    def percolation_max_k(self) -> int:
        return int(self.steps.get("percolation", {}).get("max_k", 100))

    def path(self, name: str, default: str | None = None) -> str:
        """A folder or file of the output, such as ``clustering_dir`` or ``scores_csv``, below base_dir unless it is absolute."""
        out = self.raw["output"]
        at = out.get(name, default or name.removesuffix("_dir"))
        return at if at.startswith("/") or "://" in at else f"{str(out.get('base_dir', '.')).rstrip('/')}/{at}"

    def write_manifest(self, spark: SparkSession, sections: DataFrame, out: str) -> None:
        """The run's name, features, graphs and expected outputs per step as one JSON object in a text table."""
        counts = {r["step"]: r["count"] for r in expected(spark, self, sections).groupBy("step").count().collect()}  # one row per step
        text = json.dumps({"run_name": self.run_name, "features": self.features, "phenographs": self.phenographs, "graph_k": self.graph_k, "percolation_max_k": self.percolation_max_k, "expected": counts})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(out)


@dataclass
class ComparisonConfig:
    """A checked configuration of pairwise comparisons; missing keys and values out of range raise ValueError."""

    configs: str
    labels: str
    output: str
    sections: list[str] | None = None
    id_cols: tuple[str, ...] = ()
    min_labels: int = 1

    @classmethod
    def of(cls, raw: dict) -> ComparisonConfig:
        inp, out = raw.get("input", {}), raw.get("output", {})
        if lacking := [k for k, d in (("configs_csv", inp), ("clustering_dir", inp), ("base_dir", out)) if k not in d]:
            raise ValueError(f"configuration lacks {lacking}")
        c = raw.get("comparison", {})
        if int(c.get("min_labels", 1)) < 1:
            raise ValueError("min_labels must be at least 1")
        return cls(inp["configs_csv"], inp["clustering_dir"], out["base_dir"], inp.get("sections"), tuple(c.get("id_cols", ())), int(c.get("min_labels", 1)))


def matching(names: list[str], patterns: str | list[str]) -> list[str]:
    """Names that match any shell pattern, in their own order, once each. A literal that isn't there raises ValueError."""
    out = []
    for p in [patterns] if isinstance(patterns, str) else patterns:
        rx = re.compile("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in ("*" if p == "all" else p)) + "$")
        hit = [n for n in names if rx.match(n)]
        if not hit and not re.search(r"[*?]", p) and p != "all":
            raise ValueError(f"no feature named {p}")
        out += hit
    return list(dict.fromkeys(out))


def expected(spark: SparkSession, config: RunConfig, sections: DataFrame) -> DataFrame:
    """(step, rel_path) of all outputs: features, graphs, clusterings and percolation scores of all sections."""
    rows = [("features", f"features_{f}") for f in config.features]
    g = config.steps.get("graphs", {})
    rows += [("graphs", f"graph_{f}_{d}") for f in config.features for d in g.get("distances", [])]
    folders = []
    for m in config.methods:
        if m.method == "preexisting":
            folders += [(f"Preexisting_{lv}", False) for lv in m.levels]
        elif m.method in ("kmeans", "lda"):
            folders += [(f"{'Kmeans' if m.method == 'kmeans' else 'LDA'}_{dt}/k_{k}", True) for dt in m.data_types for k in m.k_values or grids.k_values()]
        else:
            head = "Leiden" if m.method == "leiden" else "PhenoGraph"
            folders += [(f"{head}{grids.data_type_name(dt)}{d.capitalize()}/res_{r:.3f}".replace(".", "p"), True) for dt in m.data_types for d in m.distances for r in grids.resolution_values(m.n_resolutions, m.log_min, m.log_max)]
    out = spark.createDataFrame(rows or [], "step string, rel_path string")
    f = spark.createDataFrame(folders or [], "folder string, clustered boolean").crossJoin(sections.select("section").distinct())
    path = lambda ext: F.concat("folder", F.lit("/"), "section", F.lit(ext))
    clusterings = f.where("clustered").select(F.lit("clustering").alias("step"), path(".npy").alias("rel_path"))
    return out.unionByName(clusterings).unionByName(f.select(F.lit("percolation").alias("step"), path(".score").alias("rel_path")))


def status(spark: SparkSession, config: RunConfig, sections: DataFrame, existing: DataFrame) -> DataFrame:
    """Progress per step."""
    return results.progress(expected(spark, config, sections), existing)


def pending(spark: SparkSession, config: RunConfig, sections: DataFrame, existing: DataFrame) -> DataFrame:
    """Outputs that are still to be made."""
    return results.pending(expected(spark, config, sections), existing, ["step", "rel_path"])
