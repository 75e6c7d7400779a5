"""Quality rules by distribution divergence.

Each document's histogram of character classes, and its histogram of the language's most common words, is compared
with the language's reference by the Jensen-Shannon distance (base 2, so 0 to 1). References are counted over all
documents of the language, whatever its share of the table, and joined on the language. A language with less text
than MIN_REFERENCE_CHARS or MIN_REFERENCE_WORDS has no such reference, and its rows no such distance: no language is
judged by another one. A distance counts only from a minimum length on: short histograms are noise. On top stand the
base rules on short and repetitive texts.

Nulls: a null text has no words and fails; a null language has no reference. An empty text fails. Repeated rows get
equal verdicts. Other columns are not looked at.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociframe.llm.common import free_name, table_cut

COMMON_WORDS = 100
MIN_REFERENCE_CHARS = 10_000
MIN_REFERENCE_WORDS = 1_000
MIN_WORDS_BASE = 10
REPEAT_PERCENT = 20
WINDOW = 5

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\W\d_]+")
SYMBOLS = "#*$%&|<>"
CLASSES = ["other", "space", "lower", "upper", "digit", "stop", "mark", "symbol", "accented", "letter"]
_FLUSH = 200_000

RESULT = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, char_distance double, word_distance double")


@dataclass(frozen=True)
class Limits:
    """Largest distances, and the characters or words from which they count."""

    char_distance: float = 0.22
    min_chars: int = 150
    word_distance: float = 0.65
    min_words: int = 50


def _class_table() -> np.ndarray:
    """Class number of each code point below 0x250; beyond it all count as letters of other scripts."""
    table = np.zeros(0x251, dtype=np.int64)
    for code in range(0x250):
        c = chr(code)
        if c.isspace():
            kind = "space"
        elif c.isalpha():
            kind = "accented" if code > 127 else "lower" if c.islower() else "upper"
        elif c.isdigit():
            kind = "digit"
        elif c in ".,;:'\"?-":
            kind = "stop"
        elif c in "!()[]/_":
            kind = "mark"
        elif 32 < code < 127:
            kind = "symbol"
        else:
            kind = "other"
        table[code] = CLASSES.index(kind)
    table[0x250] = CLASSES.index("letter")
    return table


def char_classes(text: str, table: np.ndarray) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.bincount(table[np.minimum(codes, 0x250)], minlength=len(CLASSES))


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits of two histograms; 1 if either is empty."""
    if p.sum() <= 0 or q.sum() <= 0:
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, d / 2)))


def repeated_words(words: list[str], size: int = WINDOW) -> int:
    """Words that lie in a window of `size` words that the text holds twice or more."""
    if len(words) <= size:
        return 0
    windows = list(zip(*(words[i:] for i in range(size))))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, covered = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + size - max(i, covered)
            covered = i + size
    return total


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


def language_counts(docs: DataFrame) -> DataFrame:
    """(lang, kind, term, n): kind 0 counts a character class, kind 1 a lower-case word."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = _class_table()
        words: dict[str | None, Counter] = {}
        chars: dict[str | None, np.ndarray] = {}

        def flush():
            rows = [(lang, 1, w, n) for lang, c in words.items() for w, n in c.items()]
            rows += [(lang, 0, name, int(n)) for lang, v in chars.items() for name, n in zip(CLASSES, v) if n]
            words.clear()
            chars.clear()
            return pd.DataFrame(rows, columns=["lang", "kind", "term", "n"])

        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                if text is None:
                    continue
                lang = lang if isinstance(lang, str) else None
                words.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
                chars[lang] = chars.get(lang, 0) + char_classes(text, table)
            if sum(map(len, words.values())) > _FLUSH:
                yield flush()
        yield flush()

    counted = docs.select("text", F.col("lang").cast("string").alias("lang")).mapInPandas(count, "lang string, kind int, term string, n long")
    return counted.groupBy("lang", "kind", "term").agg(F.sum("n").alias("n"))


def references(docs: DataFrame, common: int = COMMON_WORDS) -> DataFrame:
    """lang, ref: the reference of each language with enough text, as JSON: chars [{term, n}], words [{term, n}], total."""
    counts = table_cut(language_counts(docs.filter(F.col("lang").isNotNull())), "language-counts")
    sizes = counts.groupBy("lang").agg(F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("chars"), F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("total"))
    best = W.partitionBy("lang").orderBy(F.desc("n"), "term")
    top = counts.filter("kind = 1").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= common).drop("place")
    listed = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("term", "n"))))
    refs = top.unionByName(counts.filter("kind = 0")).groupBy("lang").agg(listed(0).alias("char_list"), listed(1).alias("word_list")).join(sizes, "lang")
    parts = F.struct(F.when(F.col("chars") >= MIN_REFERENCE_CHARS, F.col("char_list")).alias("chars"), F.when(F.col("total") >= MIN_REFERENCE_WORDS, F.col("word_list")).alias("words"), "total")
    return table_cut(refs.filter((F.col("chars") >= MIN_REFERENCE_CHARS) | (F.col("total") >= MIN_REFERENCE_WORDS)).select("lang", F.to_json(parts).alias("ref")), "references")


class References:
    """References from their JSON: class counts or None, {word: count} or None, words in all. Keeps those met, up to a limit."""

    def __init__(self, limit: int = 200):
        self.known: dict[str, tuple] = {}
        self.limit = limit

    def __call__(self, ref: str | None) -> tuple | None:
        if not isinstance(ref, str):
            return None
        if ref not in self.known:
            if len(self.known) >= self.limit:
                self.known.clear()
            x, chars = json.loads(ref), np.zeros(len(CLASSES))
            for c in x.get("chars", []):
                chars[CLASSES.index(c["term"])] = c["n"]
            self.known[ref] = (chars if "chars" in x else None, {w["term"]: w["n"] for w in x["words"]} if "words" in x else None, x.get("total", 0))
        return self.known[ref]


def _with_reference(docs: DataFrame, refs: DataFrame, name: str) -> DataFrame:
    """The rows with their language's reference in the column `name`, null if it has none."""
    key = free_name(docs, "__lang")
    return docs.join(refs.select(F.col("lang").alias(key), F.col("ref").alias(name)), F.col("lang").cast("string") == F.col(key), "left").drop(key)


def judge(text: str | None, ref: tuple | None, table: np.ndarray, limits: Limits = Limits()) -> tuple:
    """The measures and verdict of one text by its language's reference, in the order of RESULT without the id."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    symbols = sum(text.count(s) for s in SYMBOLS)
    repeat = repeated_words(words)
    failed = n < MIN_WORDS_BASE or 100 * repeat > REPEAT_PERCENT * n
    char_d = word_d = None
    if ref is not None:
        if ref[0] is not None and len(text) >= limits.min_chars:
            char_d = js_distance(char_classes(text, table).astype(float), ref[0])
        own = LETTERS.findall(text.lower()) if ref[1] is not None else []
        if ref[1] is not None and len(own) >= limits.min_words:
            counts = Counter(w for w in own if w in ref[1])
            names = list(ref[1])
            p = np.array([counts[w] for w in names] + [len(own) - sum(counts.values())], dtype=float)
            q = np.array([ref[1][w] for w in names] + [ref[2] - sum(ref[1].values())], dtype=float)
            word_d = js_distance(p, q)
    kept = not failed and (char_d is None or char_d <= limits.char_distance) and (word_d is None or word_d <= limits.word_distance)
    return n, sum(map(len, words)), symbols, repeated_lines(text), repeat, failed, kept, char_d, word_d


def quality_rules(docs: DataFrame, limits: Limits = Limits(), refs: DataFrame | None = None) -> DataFrame:
    """One row for each document, as RESULT says."""
    refs = references(docs) if refs is None else refs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, known = _class_table(), References()
        names = [c.split()[0] for c in RESULT.split(", ")]
        for batch in batches:
            rows = [judge(t if isinstance(t, str) else None, known(x), table, limits) for t, x in zip(batch["text"], batch["ref"])]
            out = pd.DataFrame(rows, columns=names[1:])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").values)
            for c in ("char_distance", "word_distance"):
                out[c] = out[c].astype("float64")
            yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    return _with_reference(rows, refs, "ref").select("doc_id", "text", "ref").mapInPandas(run, RESULT)


def keep(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows that the rules keep, with all columns as they were: the verdict is a column of the same pass."""
    name = free_name(docs, "__ref")

    @F.pandas_udf("boolean")
    def verdict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        table, known = _class_table(), References()
        for texts, refs in batches:
            yield pd.Series([judge(t if isinstance(t, str) else None, known(x), table, limits)[6] for t, x in zip(texts, refs)], dtype=bool)

    return _with_reference(docs, references(docs), name).filter(verdict(F.col("text"), F.col(name))).drop(name)
