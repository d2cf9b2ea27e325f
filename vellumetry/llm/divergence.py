"""Quality rules by divergence of distributions.

``language_references`` builds, for each value of the language column, two
histograms over all documents: of character classes (code points of words) and
of the language's most common words, the rest being one bin more.
``judge`` compares each document's own histograms to those of its language with
the Jensen-Shannon distance (base 2, 0 to 1). A short text's histogram is noisy,
so the limit on words falls with the square root of the length, and documents
or languages with fewer words than a minimum are not judged by distances.

Common words are found without a count of all words: a word with share ``s`` of
a language has at least that share in some batch, so batches propose, the
proposals are pruned to at most ``2 / min_share`` a language, and a second
pass counts those exactly. The result does not depend on the batches.

Null texts have no words. Null languages are a language of their own. Words are
runs of anything but ASCII white space. Tables may be empty. Columns other
than the three named are carried through by ``filter_documents`` alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumetry.llm.common import read_table, release, utf8

#: Classes of characters; white space is not counted.
LOWER, UPPER, DIGIT, STOP, SYMBOL, OTHER, LETTER, SPACE = range(8)
N_CLASSES = 7
SYMBOLS = set(b"#*$%&|<>")


@dataclass(frozen=True)
class Limits:
    """Production parameters."""

    #: base rules
    min_words: int = 50
    max_repeat_percent: int = 50
    #: common words of a language: how many at most, and the least share of its words
    n_common: int = 50
    min_share: float = 0.001
    #: a language with fewer words has no reference; its documents pass this rule
    min_reference_words: int = 2000
    #: documents with fewer words aren't judged by distances
    min_judged_words: int = 50
    max_char_distance: float = 0.30
    #: words: flat + by_length / sqrt(number of words)
    max_word_distance: float = 0.22
    word_distance_by_length: float = 1.9


def _class_table() -> np.ndarray:
    table = np.full(1 << 16, OTHER, "u1")
    for c in range(1 << 16):
        ch = chr(c)
        if ch in " \t\n\r\x0b\x0c":
            table[c] = SPACE
        elif ch.islower():
            table[c] = LOWER if c < 128 else LETTER
        elif ch.isupper():
            table[c] = UPPER if c < 128 else LETTER
        elif ch.isdigit():
            table[c] = DIGIT
        elif ch in ".,;:!?'\"()-":
            table[c] = STOP
        elif ch.isalpha():
            table[c] = LETTER
        elif c < 128:
            table[c] = SYMBOL
    return table


_table: np.ndarray | None = None


def char_classes(text: str) -> np.ndarray:
    """Counts of the classes but white space's; that one comes last."""
    global _table
    if _table is None:
        _table = _class_table()
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return np.bincount(_table[np.minimum(points, 0xFFFF)], minlength=8)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the last axis' distributions, base 2."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more."""
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) == len(grams):
        return 0
    count, inside = Counter(grams), bytearray(len(words))
    for i, g in enumerate(grams):
        if count[g] > 1:
            inside[i : i + 3] = b"\1\1\1"
    return sum(inside)


def duplicate_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\n\r\x0b\x0c"):
            n += line in seen
            seen.add(line)
    return n


_HIST = "lang string, kind string, key binary, n long"


def _rows(count: dict) -> Iterator[pa.RecordBatch]:
    if count:
        keys = list(count)
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array([k[0] for k in keys], pa.string()), "kind": [k[1] for k in keys], "key": pa.array([k[2] for k in keys], pa.binary()), "n": pa.array([count[k] for k in keys], pa.int64())}
        )


def language_references(df: DataFrame, limits: Limits = Limits(), *, text: str = "text", lang: str = "lang") -> dict:
    """{language: (shares of classes, common words, their shares and the rest's)} for those with enough words."""
    rows = df.select(F.col(lang).cast("string").alias("l"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    share = limits.min_share / 2

    def propose(batches):
        for b in batches:
            words, out = {}, Counter()
            for l, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words.setdefault(l, Counter()).update(utf8(t).split())
                for c, n in enumerate(char_classes(t)[:N_CLASSES]):
                    out[l, "c", bytes([c])] += int(n)
            for l, count in words.items():
                total = sum(count.values())
                out[l, "n", b""] += total
                for w, n in count.items():
                    if n >= total * share and any(map(str.isalpha, w.decode())):
                        out[l, "w", w] += n
            yield from _rows(out)

    found = rows.mapInArrow(propose, _HIST).groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    from vellumetry.llm.common import materialise

    found = materialise(found, "references")
    totals = {r.lang: r.n for r in found.where("kind = 'n'").collect() if r.n >= limits.min_reference_words}
    classes: dict = {l: np.zeros(N_CLASSES) for l in totals}
    for r in found.where("kind = 'c'").collect():
        if r.lang in classes:
            classes[r.lang][r.key[0]] = r.n
    total = found.where("kind = 'n'").select(F.col("lang").alias("of"), F.col("n").alias("total"))
    pruned = found.where("kind = 'w'").join(total, F.col("lang").eqNullSafe(F.col("of"))).where(F.col("n") >= share * F.col("total"))
    candidates: dict = {}
    for r in pruned.select("lang", "key").collect():
        if r.lang in totals:
            candidates.setdefault(r.lang, set()).add(bytes(r.key))

    def count(batches):
        for b in batches:
            out = Counter()
            for l, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if own := candidates.get(l):
                    words = utf8(t).split()
                    for w, n in Counter(filter(own.__contains__, words)).items():
                        out[l, "w", w] += n
                    out[l, "x", b""] += letterless(words)
            yield from _rows(out)

    exact: dict = {l: {} for l in totals}
    bare: dict = {}
    if candidates:
        for r in rows.mapInArrow(count, _HIST).groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).collect():
            if r.kind == "x":
                bare[r.lang] = r.n
            else:
                exact[r.lang][bytes(r.key)] = r.n
    out = {}
    for l, n in totals.items():
        common = sorted((w for w, k in exact[l].items() if k >= n * limits.min_share), key=lambda w: (-exact[l][w], w))[: limits.n_common]
        own = np.array([exact[l][w] for w in common], "f8")
        rest = n - own.sum() - bare.get(l, 0)
        out[l] = (classes[l] / max(1, classes[l].sum()), common, np.append(own, [bare.get(l, 0), rest]) / n)
    return out


def letterless(words: list[bytes]) -> int:
    """Words without any letter, which have a bin of their own: no language has many."""
    return sum(not any(map(str.isalpha, w.decode("utf-8", "replace"))) for w in words if not w.isalpha())


VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def judge_batch(texts: list, langs: list, references: dict, limits: Limits) -> dict[str, list]:
    out: dict[str, list] = {x.split()[0]: [] for x in VERDICT.split(", ")}
    for t, l in zip(texts, langs):
        raw = utf8(t)
        words = raw.split()
        n = len(words)
        classes = char_classes(t or "")
        repeats = repeat_words(words)
        failed = n < limits.min_words or 100 * repeats > limits.max_repeat_percent * n
        by_char = by_word = None
        kept = not failed
        if n >= limits.min_judged_words and (ref := references.get(l)):
            shares, common, common_shares = ref
            own = Counter(words)
            counts = np.array([own[w] for w in common], "f8")
            by_char = float(js_distance(classes[:N_CLASSES] / max(1, classes[:N_CLASSES].sum()), shares))
            bare = letterless(words)
            by_word = float(js_distance(np.append(counts, [bare, n - counts.sum() - bare]) / n, common_shares))
            kept = kept and by_char <= limits.max_char_distance and by_word <= limits.max_word_distance + limits.word_distance_by_length / n**0.5
        row = (n, int(classes.sum() - classes[SPACE]), sum(raw.count(s) for s in SYMBOLS), duplicate_lines(raw), repeats, failed, kept, by_char, by_word)
        for column, v in zip(out.values(), row):
            column.append(v)
    return out


def judge(df: DataFrame, limits: Limits = Limits(), references: dict | None = None, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts, base rule and verdict of each document; distances are null where they aren't judged."""
    if references is None:
        references = language_references(df, limits, text=text, lang=lang)

    def run(batches):
        for b in batches:
            for part in (b.slice(i, 2048) for i in range(0, b.num_rows, 2048)):
                cols = judge_batch(part.column(1).to_pylist(), part.column(2).to_pylist(), references, limits)
                types = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0)} | {x.split()[0]: pa.array(cols[x.split()[0]], types[x.split()[1]]) for x in VERDICT.split(", ")})

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).mapInArrow(run, f"doc_id long, {VERDICT}")


def filter_documents(df: DataFrame, limits: Limits = Limits(), *, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that are kept, with all their columns."""
    references = language_references(df, limits, text=text, lang=lang)
    schema = df.schema
    at = [df.columns.index(text), df.columns.index(lang)]

    def run(batches):
        for b in batches:
            kept = judge_batch(b.column(at[0]).to_pylist(), b.column(at[1]).cast(pa.string()).to_pylist(), references, limits)["kept"]
            yield b.filter(pa.array(kept, pa.bool_()))
        release()

    return df.mapInArrow(run, schema)


def op2_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"))
