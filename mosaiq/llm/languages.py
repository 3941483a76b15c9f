"""Language of documents and of passages in another language, by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of its labelled text. A text is cut, from left to
right, into the longest phrases that occur in a language's sample; a text in that language needs few, long phrases.
A word's cost in a language is its share of phrases, and the languages of a document are the cheapest sequence over
its words where each change of language costs extra; passages of four words and more in another language come out,
single foreign words don't. The sample's own labels may be wrong: sentences are kept only where the words of the
whole sample agree with the label.
"""

from __future__ import annotations

import html
import re
import sys
import types
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Two-letter code, three-letter codes, English name.
SPELLINGS = {
    "en": ("eng", "english"),
    "de": ("deu", "ger", "german"),
    "nl": ("nld", "dut", "dutch"),
    "fr": ("fra", "fre", "french"),
    "es": ("spa", "spanish"),
    "pt": ("por", "portuguese"),
    "it": ("ita", "italian"),
    "sv": ("swe", "swedish"),
    "da": ("dan", "danish"),
    "ru": ("rus", "russian"),
}
SAMPLE_DOCS = 1500  # labelled documents per language from which the models are made, at most
SAMPLE_CHARS = 3000  # a longer document isn't taken as sample
CORPUS_CHARS = 40_000  # distinct sample text per language in its automaton, at most
SWITCH = 1.3  # what a change of language costs, in phrases
LEAST_WORDS = 4  # words of a passage in another language
MOST_OF_AROUND = 0.6  # phrases of a passage in its own language, against those in the language around it
LEAST_LETTERS = 30  # texts with fewer are no case
MOST_PHRASES = 0.24  # phrases per letter beyond which a text is in none of the languages
CLEARLY = 3.0  # log odds by which a passage of the sample must speak for another language to be dropped
CACHE = 100_000  # fragments whose costs a worker keeps


def label_language(label: str | None) -> str | None:
    """The language that a label names, with or without a country, or None."""
    if not label:
        return None
    key = re.split(r"[-_\s]", label.strip().lower())[0]
    if key in SPELLINGS:
        return key
    return next((k for k, names in SPELLINGS.items() if key in names), None)


_FOLD = str.maketrans({"ø": "o", "æ": "ae", "ß": "ss", "œ": "oe", "đ": "d", "ł": "l"})
_TAG = re.compile(r"<[^<>]{0,80}>")
_BREAK = re.compile(r"[^\w'’\s,\-]+|\s-\s|\n")
_WORD = re.compile(r"[^\W_]+", re.UNICODE)


def fold(text: str) -> str:
    """Lower case without accents, entities resolved."""
    t = unicodedata.normalize("NFKD", html.unescape(text).lower().translate(_FOLD))
    return "".join(c for c in t if not unicodedata.combining(c))


def strip_markup(text: str) -> str:
    return html.unescape(_TAG.sub(" ", html.unescape(text)))


def fragments(text: str, names: frozenset[str]) -> list[tuple[str, ...]]:
    """Runs of words between punctuation, numbers and names of items. Numbers and names are left out."""
    out: list[tuple[str, ...]] = []
    for piece in _BREAK.split(fold(_TAG.sub("\n", html.unescape(text)))):
        run: list[str] = []
        for w in _WORD.findall(piece):
            if w in names or not w.isalpha():
                if run:
                    out.append(tuple(run))
                run = []
            else:
                run.append(w)
        if run:
            out.append(tuple(run))
    return out


def name_words(names) -> frozenset[str]:
    """Words of item names, as they come up in texts."""
    return frozenset(w for n in names for w in _WORD.findall(fold(n)))


class Automaton:
    """Suffix automaton of a text: which strings occur in it, walked from the root a character at a time."""

    def __init__(self, text: str):
        nxt: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.next = nxt

    def phrases(self, text: str) -> list[int]:
        """Lengths of the phrases of a greedy cross-parse; a character that doesn't occur is a phrase of its own."""
        nxt, out, i, n = self.next, [], 0, len(text)
        while i < n:
            state, j = nxt[0], i
            while j < n:
                s = state.get(text[j])
                if s is None:
                    break
                state = nxt[s]
                j += 1
            j = max(j, i + 1)
            out.append(j - i)
            i = j
        return out


class Model:
    """Automata of all languages; costs of fragments and languages of texts."""

    def __init__(self, corpora: dict[str, str], names: frozenset[str]):
        self.langs = sorted(corpora)
        self.automata = [Automaton(corpora[k]) for k in self.langs]
        self.names = names
        self.cache: dict[tuple[str, ...], np.ndarray] = {}

    def costs(self, words: tuple[str, ...]) -> np.ndarray:
        """(word, language): phrases that fall to each word, a phrase being spread evenly over its characters."""
        got = self.cache.get(words)
        if got is not None:
            return got
        text = f" {' '.join(words)} "
        ends = np.cumsum([len(w) + 1 for w in words])  # each word with the blank before it
        out = np.empty((len(words), len(self.langs)))
        for k, a in enumerate(self.automata):
            lens = np.array(a.phrases(text))
            c = np.repeat(1.0 / lens, lens)
            cum = np.r_[0.0, np.cumsum(c)]
            out[:, k] = np.diff(np.r_[0.0, cum[ends]])
        if len(self.cache) >= CACHE:
            self.cache.clear()
        self.cache[words] = out
        return out

    def passages(self, text: str) -> list[tuple[str, int, float]]:
        """(language, words, confidence) of each passage of a text, in order; empty if it has no language.

        Passages are maximal; those of fewer than LEAST_WORDS words go to what is around them. Confidence is
        1 - best / second of the phrases that the passage needs in the two languages needing fewest.
        """
        frags = fragments(text, self.names)
        if not frags or sum(c.isalpha() for c in strip_markup(text)) < LEAST_LETTERS:
            return []
        cost = np.concatenate([self.costs(f) for f in frags])
        letters = sum(len(w) + 1 for f in frags for w in f)
        total = cost.sum(0)
        best = int(total.argmin())
        if (total[best] - cost.min(1).sum()) <= SWITCH:  # no change of language can pay
            path = np.full(len(cost), best)
        else:
            path = self._cheapest(cost)
        if cost[np.arange(len(cost)), path].sum() > MOST_PHRASES * letters:
            return []
        path = self._without_short(path, cost)
        cuts = np.flatnonzero(np.r_[True, path[1:] != path[:-1], True])
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            c = np.sort(cost[a:b].sum(0))
            out.append((self.langs[path[a]], int(b - a), float(1 - c[0] / c[1]) if len(c) > 1 and c[1] > 0 else 0.0))
        return out

    def _cheapest(self, cost: np.ndarray) -> np.ndarray:
        n, k = cost.shape
        at = cost[0].copy()
        back = np.empty((n, k), np.int64)
        same = np.arange(k)
        for i in range(1, n):
            j = int(at.argmin())
            change = at[j] + SWITCH < at
            back[i] = np.where(change, j, same)
            at = np.where(change, at[j] + SWITCH, at) + cost[i]
        path = np.empty(n, np.int64)
        path[-1] = at.argmin()
        for i in range(n - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        return path

    @staticmethod
    def _without_short(path: np.ndarray, cost: np.ndarray) -> np.ndarray:
        """Give passages that are too short, or hardly cheaper than around, to the cheaper neighbour, the shortest first."""
        path = path.copy()
        while True:
            cuts = np.flatnonzero(np.r_[True, path[1:] != path[:-1], True])
            if len(cuts) <= 2:
                return path
            for i in np.argsort(np.diff(cuts), kind="stable"):
                a, b = cuts[i], cuts[i + 1]
                around = min((path[j] for j in (a - 1, b) if 0 <= j < len(path)), key=lambda k: cost[a:b, k].sum())
                if b - a < LEAST_WORDS or cost[a:b, path[a]].sum() > MOST_OF_AROUND * cost[a:b, around].sum():
                    path[a:b] = around
                    break
            else:
                return path


def clean_sample(docs: list[tuple[str, str]], names: frozenset[str]) -> dict[str, str]:
    """Texts of a labelled sample to one corpus per language.

    A fragment goes to the label under which it is most frequent, if the words of each passage in it, weighed by how
    often they occur under each label, speak for that label too. That drops wrong labels and passages in other languages. Each
    fragment is taken once, the most frequent first, up to CORPUS_CHARS.
    """
    words: dict[str, Counter] = defaultdict(Counter)
    parsed = [(lang, fragments(text, names)) for lang, text in docs]
    for lang, frags in parsed:
        for w in {w for f in frags for w in f}:
            words[w][lang] += 1
    per = Counter(lang for lang, _ in parsed)
    langs = sorted(per)

    known: dict[str, np.ndarray] = {}

    def score(w: str) -> np.ndarray:
        if w not in known:
            share = np.array([(words[w][k] + 0.02) / (per[k] + 0.2) for k in langs])
            known[w] = np.log(share / share.sum())
        return known[w]

    def speaks(f: tuple[str, ...], lang: str) -> bool:
        """Whether no passage of LEAST_WORDS words speaks clearly for another language."""
        cum = np.cumsum([np.zeros(len(langs)), *[score(w) for w in f]], axis=0)
        n = min(LEAST_WORDS, len(f))
        s = cum[n:] - cum[:-n]
        return bool((s.max(axis=1) - s[:, langs.index(lang)] < CLEARLY).all())

    seen: dict[tuple[str, ...], Counter] = defaultdict(Counter)
    for lang, frags in parsed:
        for f in set(frags):
            seen[f][lang] += 1
    kept: dict[str, list] = {k: [] for k in langs}
    for f, by in seen.items():
        # a wrong label or a passage in another language leaves few traces under its label, and more under its own
        lang, n = max(by.items(), key=lambda x: (x[1] / per[x[0]], x[0]))
        if speaks(f, lang):
            kept[lang].append((n, f))
    for k in langs:
        kept[k].sort(key=lambda x: (-x[0], x[1]))
        size, out = 0, []
        for _, f in kept[k]:
            if size >= CORPUS_CHARS:
                break
            out.append(f)
            size += sum(map(len, f)) + len(f)
        kept[k] = out
    return {k: " " + "  ".join(" ".join(f) for f in v) + " " for k, v in kept.items() if v}


def fit(docs: DataFrame, text: str = "text", label: str = "lang", names: frozenset[str] = frozenset(), id_col: str = "doc_id") -> dict[str, str]:
    """Corpora per language from at most SAMPLE_DOCS labelled documents each, picked by hash of their id."""
    spark = docs.sparkSession
    known = [(s, k) for k, v in SPELLINGS.items() for s in (k, *v)]
    m = F.broadcast(spark.createDataFrame(known, "key string, language string"))
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"), F.split(F.lower(F.trim(F.col(f"`{label}`"))), r"[-_\s]")[0].alias("key"))
    d = d.where(F.length("text").between(LEAST_LETTERS, SAMPLE_CHARS)).join(m, "key").select("language", "text", F.xxhash64("id").alias("h"))
    w = W.partitionBy("language").orderBy("h", "text")
    got = d.withColumn("n", F.row_number().over(w)).where(F.col("n") <= SAMPLE_DOCS).select("language", "text").collect()
    return clean_sample([(r["language"], r["text"]) for r in got], names)


DOCS_A_TASK = 5_000  # on average


def _worker_model(key: int, parts) -> Model:
    """The model of this Python worker, built once from a broadcast sample and kept, with its cache, for later tasks.

    Functions reach the workers by value, with globals of their own for each task, so it is kept as a module.
    """
    kept = sys.modules.setdefault("_mosaiq_worker", types.ModuleType("_mosaiq_worker"))
    if getattr(kept, "key", None) != key:
        kept.key, kept.model = key, Model(*parts.value)
    return kept.model


PASSAGES = "id long, label string, passage int, lang string, n_words int, confidence double"


def passages(docs: DataFrame, corpora: dict[str, str], names: frozenset[str] = frozenset(), text: str = "text", label: str = "lang", id_col: str = "doc_id", tasks: int | None = None) -> DataFrame:
    """(id, label, passage, lang, n_words, confidence): each passage of each document, in order.

    ``label`` is the language that the document's own label names, or null. Documents whose text is null, has fewer
    than LEAST_LETTERS letters, or is in none of the languages give no rows; rows with null ids are left out.
    Documents are dealt evenly over tasks; texts are read whole.
    """
    key = hash((tuple(sorted(corpora.items())), names))
    parts = docs.sparkSession.sparkContext.broadcast((corpora, names))  # at most CORPUS_CHARS a language, and the names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _worker_model(key, parts)
        for b in batches:
            rows = []
            for i, t, lab in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                mine = label_language(lab)
                rows += [(i, mine, n, *p) for n, p in enumerate(model.passages(t))]
            if rows:
                cols = list(zip(*rows))
                types_ = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, types_)], ["id", "label", "passage", "lang", "n_words", "confidence"])

    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{label}`").alias("lab")).where("id is not null and text is not null")
    n = tasks or max(4 * docs.sparkSession.sparkContext.defaultParallelism, -(-d.count() // DOCS_A_TASK))
    return d.repartition(n, F.xxhash64("id", F.length("text"))).mapInArrow(run, PASSAGES)


def label_errors(found: DataFrame) -> DataFrame:
    """(id, lang): documents whose label is missing or wrong, or that hold several languages; a row per language."""
    per = found.groupBy("id").agg(F.collect_set("lang").alias("langs"), F.max("label").alias("label"))  # at most as many as there are languages
    bad = (F.size("langs") > 1) | F.col("label").isNull() | ~F.array_contains("langs", F.col("label"))
    return per.where(bad).select("id", F.explode("langs").alias("lang"))
