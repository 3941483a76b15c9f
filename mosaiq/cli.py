"""Command line: ``python -m mosaiq.cli <command> --help``."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from mosaiq.functions import grids
from mosaiq.operators import clustering, communities, compact, features, logs, neighborhood, neighbors, percolation, results, similarity, spatial
from mosaiq.plans import run as plans
from mosaiq.session import get_spark
from mosaiq.sources import files


def _args() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mosaiq")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, *opts: tuple[str, dict]) -> None:
        c = sub.add_parser(name, help=text)
        for o, kw in opts:
            c.add_argument(o, **kw)

    inp, out = ("--input", {"required": True}), ("--output", {"required": True})
    k = ("--k", {"type": int, "default": 15})
    add("features", "feature vectors of cells", inp, out, ("--type", {"default": "pca"}))
    add("localfreq", "type counts or weights around each cell", inp, out, k, ("--types", {"default": "class"}), ("--weighted", {"action": "store_true"}))
    add("graph", "neighbour graph in feature space", inp, out, k, ("--metric", {"default": "cosine"}), ("--column", {"default": "features"}), ("--dim", {"type": int, "required": True}))
    add("cluster", "communities, k-means or topics", inp, out, ("--method", {"choices": ("leiden", "phenograph", "kmeans", "lda"), "required": True}), ("--resolution", {"type": float, "default": 1.0}), k, ("--column", {"default": "features"}))
    add("percolate", "percolation score per section", inp, out, ("--max-k", {"type": int, "default": 100}), ("--types", {"default": "class"}))
    add("compact", "many small files into few", inp, out, ("--target-mb", {"type": int, "default": 128}))
    add("aggregate-scores", "score files to one table", inp, out, ("--pattern", {"default": "*.score"}))
    add("reduce-scores", "weighted statistics per configuration", inp, out, ("--cells", {"required": True}))
    add("ari", "pairwise adjusted Rand index of labelings", inp, out, ("--min-labels", {"type": int, "default": 1}))
    add("status", "progress of a run", inp, ("--config", {"required": True}), ("--cells", {"required": True}))
    add("derived", "derived features", inp, out, ("--operation", {"default": "pca"}), ("--n", {"type": int, "default": 50}))
    add("rescore", "scores from stored curves", inp, out)
    add("timing", "durations of the logs in a folder", inp, out)
    add("analyze-error", "suspicious logs with the lines that say so", inp, out)
    add("calibrate", "seconds per file from calibration logs", inp, out)
    add("manifest", "summary of a run", out, ("--config", {"required": True}), ("--cells", {"required": True}))
    add("calc-chunk-size", "items for a target time", ("--seconds", {"type": float, "required": True}), ("--hours", {"type": float, "default": 1.0}))
    return p


def main(argv: list[str] | None = None) -> None:
    a = _args().parse_args(argv)
    spark = get_spark(f"mosaiq {a.command}")
    read = spark.read.parquet
    if a.command == "features":
        out = features.extract(read(a.input), a.type)
    elif a.command == "localfreq":
        p = spatial.positions(read(a.input), keep=(a.types,)).withColumnRenamed(a.types, "type")
        knn = neighbors.spatial_knn(p, a.k, True)
        out = neighborhood.type_weights(knn, p, a.k, 4) if a.weighted else neighborhood.type_counts(knn, p)
    elif a.command == "graph":
        out = similarity.feature_graph(read(a.input), "cell_id", a.column, a.dim, a.k, a.metric)
    elif a.command == "cluster":
        d = read(a.input)
        if a.method == "phenograph":
            d = similarity.jaccard_topk(d, a.k).select("src", "dst", F.col("similarity").alias("weight"))
        out = {"kmeans": lambda: clustering.kmeans(d, a.column, a.k), "lda": lambda: clustering.lda(d, a.column, a.k)}.get(a.method, lambda: communities.leiden(d, a.resolution))()
    elif a.command == "percolate":
        p = spatial.positions(read(a.input), keep=(a.types,)).withColumnRenamed(a.types, "type")
        out = percolation.score_sections(p, a.max_k)
    elif a.command == "compact":
        compact.compact(read(a.input), a.output, a.target_mb << 20)
        return
    elif a.command == "aggregate-scores":
        out = files.aggregate_score_files(files.read_score_files(spark, a.input, a.pattern), a.input)
    elif a.command == "reduce-scores":
        out = results.reduce_scores(read(a.input), results.section_cells(read(a.cells)))
    elif a.command == "ari":
        out = results.adjusted_rand(results.contingency(results.distinct_labels(read(a.input))), a.min_labels)
    elif a.command == "derived":
        out = features.derive(read(a.input), a.operation, a.n)
    elif a.command == "rescore":
        out = files.rescore(spark, a.input)
    elif a.command == "timing":
        out = logs.durations(logs.parse(files.read_logs(spark, a.input)), ["job_id"])
    elif a.command == "analyze-error":
        out = logs.classify(files.read_logs(spark, a.input)).where("suspicious").drop("text")
    elif a.command == "calibrate":
        out = logs.calibration(files.read_logs(spark, a.input))
    elif a.command == "manifest":
        plans.RunConfig.from_yaml(a.config).write_manifest(spark, read(a.cells), a.output)
        return
    elif a.command == "status":
        plans.status(spark, plans.RunConfig.from_yaml(a.config), read(a.cells), read(a.input)).show(truncate=False)
        return
    else:
        spark.range(1).select(grids.chunk_size(F.lit(a.seconds), a.hours).alias("chunk_size")).show()
        return
    out.write.parquet(a.output)


if __name__ == "__main__":
    main()
