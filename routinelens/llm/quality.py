"""Quality rules as a learned decision list.

One narrow pass measures every whole text. Sequential covering then learns, from the labelled documents, an
ordered list of threshold conjunctions: a rule grows condition by condition while FOIL's gain is positive on
the growing set, is pruned from the end while that raises its worth on the pruning set, and the documents it
covers leave before the next rule grows. The list becomes one ordered Spark conditional expression.

Defined results: a null text has no words. A text under ``MIN_WORDS`` words, or with over ``MAX_REPEAT`` per
cent of its words in repeated windows, fails whatever was learned. Without labels nothing else fails. Labels
without a document and null labels are not used; of repeated labels of one id the worst counts. Repeated rows
are judged each for itself; equal gains go to the first measure and the smallest threshold. Texts are measured whole in the row that holds them,
however long. Measures are one column with a name that the documents do not have, so clashing names do no harm. No documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_WORDS = 20
MAX_REPEAT = 30
WINDOW = 8
#: At most this many labelled documents, those whose hashed ids come first, take part in the fit.
MAX_LABELLED = 20_000
#: A rule stands if this share of the labelled documents it covers is bad, on either set ...
MIN_PRECISION = 0.97
#: ... and it covers this many bad ones of the growing set.
MIN_COVER = 5
MAX_RULES = 24
MAX_CONDITIONS = 4
#: Thresholds tried for a measure: this many quantiles of its values.
CUTS = 64
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Shares, each the quotient of a count of the text and its words, lines or characters.
SHARES = ("symbols_per_word", "repeat_share", "dup_line_share", "chars_per_word", "distinct_share", "same_next_share", "upper_share", "digit_share", "mark_share", "lone_share", "top_share")
MEASURES = ("n_words", *SHARES)
NAME = "quality_measures"
STRUCT = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(s, T.DoubleType()) for s in SHARES])


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """How many words lie in windows that are found twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = np.zeros(n, np.uint64)
    for j in range(window):
        h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[j : j + n]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    a, b = order[:-1][same], order[1:][same]
    for j in range(window):
        if not np.array_equal(ids[a + j], ids[b + j]):  # two windows with one hash: tell them apart word by word
            return _repeated_exactly(ids, window)
    hit = np.zeros(n + 1, np.int64)
    hit[a] = hit[b] = 1
    return _covered(hit[:n], window)


def _covered(hit: np.ndarray, window: int) -> int:
    edge = np.zeros(len(hit) + window, np.int64)
    edge[: len(hit)] += hit
    edge[window:] -= hit
    return int(np.count_nonzero(np.cumsum(edge)))


def _repeated_exactly(ids: np.ndarray, window: int) -> int:
    windows = np.lib.stride_tricks.sliding_window_view(ids, window)
    _, which, counts = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    return _covered((counts[which.ravel()] > 1).astype(np.int64), window)


def measure(text: str) -> tuple:
    """The counts and shares of one text, in the order of COUNTS and SHARES."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    if not n:
        return (0, 0, 0, 0, 0, *[0.0] * len(SHARES))
    code = dict.fromkeys(words)
    for i, w in enumerate(code):
        code[w] = i
    ids = np.fromiter(map(code.__getitem__, words), np.int64, n)
    repeat = repeated_words(ids)
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    marks = raw.count(b"!") + raw.count(b"?")
    lone = sum(map(words.count, (b"|", b"-", b"*"))) if n < 64 else sum(int(np.count_nonzero(ids == code[w])) for w in (b"|", b"-", b"*") if w in code)
    top = int(np.bincount(ids).max())
    same = int(np.count_nonzero(ids[1:] == ids[:-1]))
    return (n, chars, symbols, dup, repeat, symbols / n, repeat / n, dup / len(lines), chars / n, len(code) / n, same / n, upper / max(1, upper + lower), digits / chars, marks / n, lone / n, top / n)


def with_measures(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns of ``carry`` (all, if None) and a struct NAME of the text's measures."""
    carry = docs.columns if carry is None else carry
    sent = carry if text_col in carry else [*carry, text_col]
    at = sent.index(text_col)
    name = NAME
    while name in carry:
        name += "_"
    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField(name, STRUCT)])
    kinds = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(SHARES)
    fields = [pa.field(f.name, k) for f, k in zip(STRUCT, kinds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t.as_py() or "") for t in batch.column(at)]
            columns = list(zip(*rows)) if rows else [[] for _ in fields]
            made = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], fields=fields)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carry))), made], [*carry, name])

    return docs.select(*[F.col(f"`{c}`") for c in sent]).mapInArrow(run, schema)


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.measure] > self.cut if self.above else x[self.measure] <= self.cut

    def column(self, struct: Column) -> Column:
        value = struct[self.measure]
        return value > self.cut if self.above else value <= self.cut


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray]) -> Rule:
    rule: list[Condition] = []
    live = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS:
        p, n = int(bad[live].sum()), int((~bad[live]).sum())
        if not p or not n:
            break
        base = np.log2(p / (p + n))
        best = (0.0, None)
        for m in MEASURES:
            values = x[m][live]
            order = np.argsort(values, kind="stable")
            ranked = bad[live][order]
            pos = np.concatenate(([0], np.cumsum(ranked)))
            upto = np.searchsorted(values[order], cuts[m], side="right")
            for above in (False, True):
                tp = p - pos[upto] if above else pos[upto]
                size = len(order) - upto if above else upto
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where((tp >= MIN_COVER) & (size > 0), tp * (np.log2(tp / size) - base), -1.0)
                k = int(np.argmax(gain)) if len(gain) else 0
                if len(gain) and gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), Condition(m, above, float(cuts[m][k])))
        if best[1] is None:
            break
        rule.append(_centred(best[1], x[best[1].measure]))
        live &= best[1].holds(x)
    return tuple(rule)


def _centred(c: Condition, values: np.ndarray) -> Condition:
    """The same condition with its threshold halfway to the next value, so that it does not touch any."""
    beyond = values[values > c.cut]
    return Condition(c.measure, c.above, (c.cut + float(beyond.min())) / 2) if len(beyond) else c


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    hit = covers(rule, x, len(bad))
    p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if _worth(rule[:k], x, bad) >= _worth(best, x, bad):
            best = rule[:k]
    return best


def _precise(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[bool, int]:
    hit = covers(rule, x, len(bad))
    p, size = int((hit & bad).sum()), int(hit.sum())
    return p >= MIN_PRECISION * size, p


def learn(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Sequential covering; every third row prunes, the others grow."""
    third = np.arange(len(bad)) % 3 == 2
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    cuts = {m: np.unique(np.quantile(x[m], np.linspace(0, 1, CUTS + 1)[:-1])) if len(bad) else np.zeros(0) for m in MEASURES}
    while len(rules) < MAX_RULES:
        g, p = left & ~third, left & third
        at = lambda s: ({m: x[m][s] for m in MEASURES}, bad[s])
        if bad[g].sum() < MIN_COVER:
            break
        # values of the bad rows that are left give finer thresholds than all rows' quantiles
        near = {m: np.unique(np.concatenate((cuts[m], np.quantile(x[m][g & bad], np.linspace(0, 1, CUTS + 1))))) for m in MEASURES}
        rule = _grow(*at(g), near)
        if not rule:
            break
        pruned = _prune(rule, *at(p)) if p.any() else rule
        if not _precise(pruned, *at(g))[0]:
            pruned = rule
        fine, covered = _precise(pruned, *at(g))
        if not fine or covered < MIN_COVER or not _precise(pruned, *at(p))[0]:
            break
        rules.append(pruned)
        left &= ~covers(pruned, x, len(bad))
    return rules


def labelled(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", limit: int = MAX_LABELLED) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The measures and labels of at most ``limit`` labelled documents, collected; true means bad."""
    name = measured.columns[-1]
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("label"))
    chosen = marks.select(F.col(id_col).alias("labelled_id"), "label").orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(limit)
    rows = measured.join(F.broadcast(chosen), measured[id_col] == chosen["labelled_id"]).select("labelled_id", "label", F.col(name).alias("m"))
    table = rows.groupBy("labelled_id").agg(F.min("label").alias("label"), F.min("m").alias("m")).select("labelled_id", "label", "m.*").toPandas()
    table = table.sort_values("labelled_id", ignore_index=True)
    return {m: table[m].to_numpy(np.float64) for m in MEASURES}, (table["label"] == 0).to_numpy(bool)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT * m["n_words"])


def verdict(rules: list[Rule], m: Column) -> Column:
    """The ordered conditional expression: true where the document is kept."""
    out = F.when(base_failed(m), F.lit(False))
    for rule in rules:
        all_hold = rule[0].column(m)
        for c in rule[1:]:
            all_hold = all_hold & c.column(m)
        out = out.when(all_hold, F.lit(False))
    return out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELLED) -> list[Rule]:
    """Learn the list from the labelled documents alone; only they are measured."""
    ids = labels.select(F.col(id_col).alias("labelled_id")).filter("labelled_id is not null").distinct().orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(limit)
    some = docs.select(id_col, text_col).join(F.broadcast(ids), F.col(id_col) == F.col("labelled_id"), "left_semi")
    return learn(*labelled(with_measures(some, text_col, [id_col]), labels, id_col, limit=limit))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the five counts, base_failed and kept."""
    rules = fit(docs, labels, id_col, text_col)
    measured = with_measures(docs, text_col, [id_col])
    m = F.col(measured.columns[-1])
    return measured.select(id_col, *[m[c].alias(c) for c in COUNTS], base_failed(m).alias("base_failed"), verdict(rules, m).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns; a narrow pass after the fit."""
    rules = fit(docs, labels, id_col, text_col)
    measured = with_measures(docs, text_col)
    name = measured.columns[-1]
    return measured.filter(verdict(rules, F.col(name))).drop(name)
