"""Personal data by weak supervision.

One narrow pass over the whole texts finds the base spans and weaker candidates. Five labelers vote on each: the
strict pattern, a check of form (digits, checksum, ranges), a gazetteer (endings, prefixes, key names), the words
before it, and its borders. Votes are yes, no or abstain. Expectation-maximisation over the counts of vote patterns
estimates, by kind, how reliable each labeler is, and its posteriors train the final classifier, a logistic
regression on votes, kind and length. The classifier adds spans; base spans always stay.

What is gathered are counts by (kind, votes, length class): at most 5 * 3^5 * 4 rows, whatever the input.

Defined results: a null or empty text has no spans, and base_sha256 is that of the empty string. Very long texts are read whole, in the
row that holds them. Offsets are code points, ends exclusive. Added spans overlap no base span and no added one of their kind;
of equal starts the shorter one is taken. Repeated rows give repeated results; columns other than the id and the text are not read, so
their names cannot clash. No documents give no rows, and no candidates no classifier.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routinelens.storage import materialise

KINDS = ("email", "ip", "card", "phone", "secret")
N_BASE = 4
LABELERS = 5
SIZES = 4
NO, YES, NONE = 0, 1, 2
#: Endings of host names, first digits of cards, names of credentials, words before personal data or other numbers.
ENDINGS = frozenset("com org net edu gov io de fr es it uk eu us info biz".split())
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35")
KEYS = frozenset("password passwd pwd token secret apikey api_key api-key".split())
HINTS = frozenset("email mail e-mail contact write phone tel telephone call mobile fax card visa mastercard amex credit ip host server address password token secret login".split())
AGAINST = frozenset("version release v isbn order invoice no number page chapter build id".split())

_NUMERIC = re.compile(r"[0-9+][0-9 .()+-]*")
#: A part that is all digits can only be followed by what follows it, so giving digits back never helps.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PLAIN_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,40} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{2,40} ?(?:\(dot\)|\[dot\]) ?[A-Za-z]{2,10}(?![A-Za-z])")
_SECRET = re.compile(r"(?<![A-Za-z])(password|passwd|pwd|token|secret|api[_-]?key)[\"']? ?[=:] ?[\"']?([A-Za-z0-9_-]{8,})", re.IGNORECASE)
_DIGITS = re.compile(r"[0-9]+")
_WORD = re.compile(r"[A-Za-z-]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: each is told by its one @, so the search goes from @ to @."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> tuple[list[list[tuple[int, int]]], list[tuple[int, int, int]]]:
    """The base spans by kind, and weak candidates (kind, start, end)."""
    base: list[list[tuple[int, int]]] = [emails(text), [], [], []]
    weak: list[tuple[int, int, int]] = []
    for region in _NUMERIC.finditer(text):
        a, b = region.span()
        if b - a < 7:
            continue
        for m in _IP.finditer(text, a, b):
            if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.group().split(".")):
                base[1].append(m.span())
        for m in _CARD.finditer(text, a, b):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19:
                if luhn(digits):
                    base[2].append(m.span())
                else:
                    weak.append((2, *m.span()))
        for m in _PHONE.finditer(text, a, b):
            if 9 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15:
                base[3].append(m.span())
        weak += [(3, *m.span()) for m in _PLAIN_PHONE.finditer(text, a, b)]
    if "at)" in text or "at]" in text:
        weak += [(0, *m.span()) for m in _SPELLED.finditer(text)]
    if "=" in text or ":" in text:
        weak += [(4, *m.span(2)) for m in _SECRET.finditer(text)]
    return base, weak


def votes(text: str, kind: int, start: int, end: int, strict: bool) -> tuple[int, ...]:
    """What the labelers say of a span: strict pattern, form, gazetteer, context, borders."""
    span = text[start:end]
    digits = "".join(_DIGITS.findall(span))
    words = [w.lower() for w in _WORD.findall(text[max(0, start - 40) : start])][-4:]
    if kind == 0:
        form = YES if not re.search(r"\.\.|^[.-]|-$", span) and len(span) < 255 else NO
        known = YES if re.split(r"[^a-z]+", span.lower().rstrip(")] "))[-1] in ENDINGS else NONE
    elif kind == 1:
        parts = [int(p) for p in span.split(".")]
        form = YES if max(parts) > 9 else NO
        known = NO if parts[0] in (0, 127) or parts[0] > 239 else YES
    elif kind == 2:
        form = YES if luhn(digits) else NO
        known = YES if digits.startswith(CARD_STARTS) else NO
    elif kind == 3:
        form = YES if 10 <= len(digits) <= 13 else NO
        known = YES if span[0] == "+" and digits[0] in "1234569" else NONE
    else:
        form = YES if any(c.isdigit() for c in span) and any(c.isalpha() for c in span) else NO
        key = re.search(r"([A-Za-z_-]+)[^A-Za-z_-]{0,5}$", text[max(0, start - 24) : start])
        known = YES if key and key.group(1).lower() in KEYS else NONE
    context = YES if HINTS.intersection(words) else NO if AGAINST.intersection(words[-2:]) else NONE
    around = text[start - 1 : start] + text[end : end + 1]
    return (YES if strict else NONE, form, known, context, NO if any(c.isalnum() for c in around) else YES)


def code_of(kind: int, said: tuple[int, ...], length: int) -> int:
    code = kind
    for v in said:
        code = code * 3 + v
    return code * SIZES + min(SIZES - 1, length // 12)


def parts_of(code: int) -> tuple[int, tuple[int, ...], int]:
    code, size = divmod(code, SIZES)
    said = []
    for _ in range(LABELERS):
        code, v = divmod(code, 3)
        said.append(v)
    return code, tuple(reversed(said)), size


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _overlaps(span: tuple[int, int], others: list[tuple[int, int]]) -> bool:
    return any(span[0] < b and a < span[1] for a, b in others)


def find(text: str) -> tuple[list[int], str, list[dict]]:
    """Counts of base spans, their digest, and all candidates as dicts, base ones first, then by kind and start."""
    base, weak = base_spans(text)
    flat = [(k, a, b) for k, spans in enumerate(base) for a, b in spans]
    taken = sorted((a, b) for _, a, b in flat)
    spans = [{"kind": k, "start": a, "end": b, "code": code_of(k, votes(text, k, a, b, True), b - a), "base": True} for k, a, b in flat]
    last: dict[int, int] = {}
    i = 0
    for a, b, k in sorted((a, b, k) for k, a, b in weak):
        while i < len(taken) and taken[i][1] <= a:  # base spans that end before it end before all later ones
            i += 1
        if not _overlaps((a, b), taken[i : i + N_BASE + 1]) and a >= last.get(k, 0):
            last[k] = b
            spans.append({"kind": k, "start": a, "end": b, "code": code_of(k, votes(text, k, a, b, False), b - a), "base": False})
    return [len(x) for x in base], hashlib.sha256(spell(flat).encode()).hexdigest(), spans


SPAN = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("code", T.IntegerType()), T.StructField("base", T.BooleanType())])


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the base counts, base_sha256 and the candidate spans with their codes. A narrow pass."""
    counts = [f"n_{k}" for k in KINDS[:N_BASE]]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in counts), T.StructField("base_sha256", T.StringType()), T.StructField("found", T.ArrayType(SPAN))])
    kind = pa.list_(pa.field("element", pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("code", pa.int32()), ("base", pa.bool_())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [find(t.as_py() or "") for t in batch.column(1)]
            columns = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(N_BASE)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], kind)], schema.fieldNames())

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def estimate(said: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM for one kind: posteriors by vote pattern, and each labeler's chance of each vote given no / yes."""
    share = (said == YES).sum(axis=1) - (said == NO).sum(axis=1)
    post = 1 / (1 + np.exp(-share.astype(float)))
    for _ in range(rounds):
        by = np.stack((weight * (1 - post), weight * post))
        prior = (by.sum(axis=1) + 1) / (weight.sum() + 2)
        chance = np.stack([np.stack([(by * (said[:, j] == v)).sum(axis=1) for v in (NO, YES, NONE)], axis=1) for j in range(LABELERS)]) + 0.5
        # a labeler is taken to be better than chance: yes is likelier of personal data than of anything else
        chance[:, 0, NO] += 1.0
        chance[:, 1, YES] += 1.0
        chance /= chance.sum(axis=2, keepdims=True)
        log = np.log(prior)[None, :] + sum(np.log(chance[j][:, said[:, j]]).T for j in range(LABELERS))
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, chance


def _features(codes: list[int]) -> np.ndarray:
    rows = []
    for c in codes:
        kind, said, size = parts_of(c)
        row = [1.0]
        row += [float(kind == k) for k in range(len(KINDS))]
        row += [float(v == YES) - float(v == NO) for v in said]
        row += [float(size == s) for s in range(SIZES)]
        rows.append(row)
    return np.array(rows)


def train(counts: dict[int, int]) -> dict[int, float]:
    """From counts by code to the classifier's probability by code."""
    if not counts:
        return {}
    codes = sorted(counts)
    weight = np.array([counts[c] for c in codes], float)
    said = np.array([parts_of(c)[1] for c in codes])
    kinds = np.array([parts_of(c)[0] for c in codes])
    target = np.zeros(len(codes))
    for k in np.unique(kinds):
        at = kinds == k
        target[at] = estimate(said[at], weight[at])[0]
    x = _features(codes)
    beta = np.zeros(x.shape[1])
    scale = weight / weight.sum()
    for _ in range(60):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (scale * (p - target)) + 1e-4 * beta
        hessian = (x * (scale * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        beta -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(codes, (1 / (1 + np.exp(-(x @ beta)))).tolist()))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bar: float = 0.5) -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_spans, the number of all spans."""
    found = materialise(candidates(docs, id_col, text_col), "personal-data")
    counted = found.select(F.explode("found.code").alias("code")).groupBy("code").count().collect()
    chance = train({r["code"]: r["count"] for r in counted})
    size = len(KINDS) * 3**LABELERS * SIZES
    said = F.lit("".join("1" if chance.get(c, 0.0) >= bar else "0" for c in range(size)))
    stays = F.filter("found", lambda s: s["base"] | (F.substring(said, s["code"] + 1, F.lit(1)) == "1"))
    order = F.array_sort(F.transform("found", lambda s: F.struct(s["kind"], s["start"], s["end"])))
    names = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    found = found.withColumn("found", stays)
    return found.select(id_col, *[f"n_{k}" for k in KINDS[:N_BASE]], "base_sha256", text.alias("spans"), F.size("found").cast("long").alias("n_spans"))


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bar: float = 0.5) -> DataFrame:
    """Per row: id and the spans as an array of (kind, start, end), for redaction by position."""
    spans = F.split("spans", ",")
    one = lambda s: F.struct(F.split_part(s, F.lit(":"), F.lit(1)).alias("kind"), F.split_part(s, F.lit(":"), F.lit(2)).cast("int").alias("start"), F.split_part(s, F.lit(":"), F.lit(3)).cast("int").alias("end"))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return scan(docs, id_col, text_col, bar).select(id_col, F.when(F.col("spans") == "", empty).otherwise(F.transform(spans, one)).alias("spans"))
