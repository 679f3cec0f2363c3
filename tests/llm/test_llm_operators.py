"""The ten operators against brute force, on edge cases and on the smallest tables."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from routinelens.llm import bpe, exact, graph, licences, mixing, pii, quality, queries, revisits, simhash, suffix, tokencount

DATA = "/root/testdata/sf0.001"
WS = r"[\x20\x09-\x0D]"
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def multiset(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


# 1
def test_bpe_equals_the_library(spark, edge, edge_rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary())
    want = Counter()
    for i, t in edge_rows + documents(spark):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    both = bpe.encode(edge, queries.vocabulary()).unionByName(bpe.encode(spark.read.parquet(f"{DATA}/documents.parquet"), queries.vocabulary()))
    assert multiset(both, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_bpe_decode_and_common_code_points(spark, edge, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary())
    encoded = bpe.encode(edge, queries.vocabulary())
    assert multiset(bpe.decode(encoded, queries.vocabulary()), "doc_id", "text") == Counter((r.doc_id, library.decode(r.ids, skip_special_tokens=False)) for r in encoded.collect())
    index = bpe.PairIndex(open(queries.vocabulary()).read())
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)}'s 1{chr(c)}" for c in range(1, 0x2100)]
    for e, (ids, _) in zip(library.encode_batch(texts, add_special_tokens=False), index.encode(texts)):
        assert " ".join(map(str, e.ids)) == ids
    assert bpe.encode(empty, queries.vocabulary()).count() == 0


def test_bpe_cache_is_bound_by_bytes(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "CACHE_BYTES", 20_000)
    library, index = Tokenizer.from_file(queries.vocabulary()), bpe.PairIndex(open(queries.vocabulary()).read())
    rng = random.Random(4)
    for _ in range(12):
        texts = ["".join(chr(rng.randrange(0x3041, 0x3097)) for _ in range(3000)), " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)), "x" * 5000]
        assert [a for a, _ in index.encode(texts)] == [" ".join(map(str, e.ids)) for e in library.encode_batch(texts, add_special_tokens=False)]
        assert index.held < 20_000 + 60 * 2 * 500 and not any(len(c) > bpe.CACHE_LENGTH for c in [*index.seen, *index.known])


# 2
@pytest.mark.parametrize("size", [1 << 20, 50, 3])
def test_token_counts(spark, tmp_path, size):
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([(t,) for t in ("a b c", None, "", "word " * 60, "x", "x")], "text string").repartition(2)
    path = str(tmp_path / "tokens")
    tokencount.write_tokens(docs, path, ranks, public_tokenizers.PATTERN)
    encoding = tokencount._encoding(open(ranks, "rb").read(), public_tokenizers.PATTERN)
    got = tokencount.documents(tokencount.blocks(spark, path, size=size)).toPandas()
    assert Counter(got["n_tokens"]) == Counter(len(encoding.encode_ordinary(r.text or "")) for r in docs.collect())
    for _, g in got.sort_values("doc_no").groupby("file"):
        assert list(g["doc_no"]) == list(range(len(g))) and list(g["start"])[1:] == list((g["start"] + g["n_tokens"] + 1))[:-1]


def test_token_counts_without_a_last_separator(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(np.array([5, 50256, 7, 8], "<u2").tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    got = tokencount.documents(tokencount.blocks(spark, str(tmp_path), size=2)).collect()
    assert sorted((r.doc_no, r.start, r.n_tokens, r.ended) for r in got) == [(0, 0, 1, True), (1, 2, 2, False)]


def test_count_tokens_of_a_table(spark, edge, empty):
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoding = tokencount._encoding(open(ranks, "rb").read(), public_tokenizers.PATTERN)
    for docs in (edge, spark.read.parquet(f"{DATA}/documents.parquet")):
        got = tokencount.count_tokens(docs, ranks, public_tokenizers.PATTERN).toPandas()
        assert Counter(got["n_tokens"]) == Counter(len(encoding.encode_ordinary(r.text or "")) for r in docs.select("text").collect())
        assert not got.duplicated(["part", "chunk", "doc_no"]).any()
        for _, g in got.sort_values("doc_no").groupby(["part", "chunk"]):
            assert list(g["doc_no"]) == list(range(len(g))) and list(g["start"]) == [0, *(g["start"] + g["n_tokens"] + 1)][:-1]
    assert tokencount.count_tokens(empty, ranks, public_tokenizers.PATTERN).count() == 0


# 3
def test_licences_base(spark, edge, edge_rows, empty):
    want = Counter()
    for i, t in edge_rows + documents(spark):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
        at = [(k, name) for name, p in licences.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want[i, len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({n for _, n in at}))] += 1
    rows = licences.scan(edge).unionByName(licences.scan(spark.read.parquet(f"{DATA}/documents.parquet")))
    assert multiset(rows, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows.collect())
    assert licences.scan(empty).count() == 0


def test_licence_templates_match_with_some_words_changed(spark):
    text = licences.TEMPLATES[0][1].replace("granted", "given")
    got = licences.scan(spark.createDataFrame([(1, "Note: " + text.upper()), (2, text.replace("documentation", "other"))], "doc_id long, text string"))
    assert {r.doc_id: (r.labels, r.score < 1) for r in got.collect()} == {1: ("mit", True), 2: ("", True)}


def test_licences_look_at_few_starts(spark):
    """Every start of every word of a template would be far more; a whole licence with some words changed is found."""
    index = licences.Index()
    whole = licences.TEMPLATES[14][1].split()
    changed = " ".join("other" if k % 9 == 4 and w not in "to deal in the software without restriction".split() else w for k, w in enumerate(whole))
    plain = ["plain words about software and license matters " * 30] * 40
    got = licences.scan(spark.createDataFrame(list(enumerate([changed, " ".join(whole), *plain])), "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0].labels == got[1].labels == "mit" and 0.8 <= got[0].score < got[1].score == 1.0
    every = sum(x in ("software", "license") for kept in index.words for _, x in kept) * 30
    assert all(r.labels == "" and r.n_looked < every / 2 for r in got[2:])


# 4
def test_fingerprints(edge_rows):
    for _, t in edge_rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        assert simhash.fingerprint((t or "").encode()) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_links_are_all_found(spark):
    rng = random.Random(1)
    prints = set()
    for _ in range(60):
        b = rng.getrandbits(64)
        prints.add(b)
        for _ in range(5):
            x = b
            for _ in range(rng.choice([1, 2, 2, 3])):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert got == {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (5, 5), (200, 100), (100, 200)]
    got = dict(tuple(r) for r in graph.star_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(1, 31)}, 101: 100, 200: 100}


def test_near_groups(spark, edge, edge_rows, empty):
    rows = edge_rows
    prints = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(len(rows)):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    want = Counter((d, f"{p:016x}", min(r[0] for r, h in zip(rows, group) if h == g)) for (d, _), p, g in zip(rows, prints, group))
    assert multiset(simhash.near_groups(edge), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_groups(empty).count() == 0


def five_word_sets(texts):
    words = [(t or "").encode().lower().split() for t in texts]
    return [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 5 else frozenset([tuple(w)] if w else []) for w in words]


def brute_similar(texts):
    """All pairs of places whose five-word sets have a Jaccard similarity of 0.8 or more, by way of common shingles."""
    sets, by = five_word_sets(texts), {}
    for k, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(k)
    seen = {(a, b) for places in by.values() for i, a in enumerate(places) for b in places[i + 1 :]}
    return {(a, b) for a, b in seen if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def families():
    """Texts of many kinds of likeness about the bar: words changed, parts cut off or added, copies of a hub unlike each other, shared passages."""
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(3000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = []
    for f in range(40):
        base = some(rng.choice([120, 400]))
        rows.append(base)
        for c in range(3):
            text = list(base)
            for _ in range(max(1, len(base) * (f % 5) // 100)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append(text)
    for f in range(30):
        base = some(200)
        rows += [base, base[: 150 + 2 * f], base + some(10 + 2 * f), base[f:] + some(f)]
    hub = some(300)
    for k in range(60):  # each of four of five alike to the hub, not to each other
        text = list(hub)
        for _ in range(6):
            text[rng.randrange(300)] = rng.choice(vocabulary)
        rows.append(text)
    rows.append(hub)
    passages = [some(60) for _ in range(6)]
    rows += [[w for p in rng.sample(passages, 4) for w in p] + some(rng.choice([5, 20, 60])) for _ in range(80)]
    rows += [["one"], ["ONE"], ["two", "words"], [], [], ["the", "same"] * 50, ["the", "same"] * 60]
    return [" ".join(t) for t in rows]


def test_similar_texts_are_all_found(spark, edge, empty, monkeypatch):
    texts = families()
    want = components(len(texts), brute_similar(texts) | {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if not texts[a] and not texts[b]})
    assert len(brute_similar(texts)) > 300
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for far, sent in ((simhash.FAR, simhash.SENT), (-1.0, 0)):  # with anchors and by the exact way alone
        monkeypatch.setattr(simhash, "FAR", far)
        monkeypatch.setattr(simhash, "SENT", sent)
        kept = [r.doc_id for r in simhash.keep_one_similar(docs).collect()]
        lone = {i for i, r in enumerate(want) if texts[i] and want.count(r) == 1}
        assert len(kept) == len(set(kept)) and lone <= set(kept)
        if far > 0:
            assert sorted(kept) == sorted(set(want))
        else:
            assert sorted(i for i in kept if texts[i]) == sorted({r for i, r in enumerate(want) if texts[i]})
    monkeypatch.undo()
    out = simhash.keep_one_similar(edge)
    assert out.columns == edge.columns and out.select("doc_id").distinct().count() == out.count() and simhash.keep_one_similar(empty).count() == 0


def test_one_of_rows_with_null_and_repeated_ids_stays(spark):
    rng = random.Random(8)
    prose = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(12)]
    near = [(t, t.replace(" ", "  ") + "\n") for t in prose]  # equal shingles, other bytes
    rows = [(None, t) for t in prose[:4]] + [(7, t) for t in prose[4:8]] + [(9, prose[8]), (None, near[8][1]), (7, prose[9]), (5, near[9][1]), (7, near[4][1]), (7, prose[5]), (3, prose[10]), (3, prose[11]), (3, near[11][1])]
    got = [(r.doc_id, r.text, r.place) for r in simhash.keep_one_similar(spark.createDataFrame([(i, t, f"own {t}") for i, t in rows], "doc_id long, text string, place string").repartition(3)).collect()]
    group = {x: k for k, pair in enumerate(near) for x in pair}
    assert sorted(group[t] for _, t, _ in got) == list(range(12)) and all(own == f"own {t}" and (i, t) in rows for i, t, own in got)
    least = {k: min((i is None, i or 0) for i, t in rows if group[t] == k) for k in range(12)}
    assert {group[t]: (i is None, i or 0) for i, t, _ in got} == least


def test_candidates_meet_all_halves_one_bit_apart(spark):
    """Against brute force over halves that differ in any one bit, the uncoded top bit included, or in none, or in two."""
    rng = random.Random(14)
    one = lambda: [rng.getrandbits(64) for _ in range(simhash.TABLES)]
    rows = []
    for bit in range(64):
        base, near, far = one(), one(), one()
        table = rng.randrange(simhash.TABLES)
        near[table], far[table] = base[table] ^ 1 << bit, base[table] ^ 1 << bit ^ 1 << (bit ^ 1)
        far[table] ^= rng.getrandbits(32) << (0 if bit >= 32 else 32)  # the other half is another one
        rows += [base, near, far]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    texts = spark.createDataFrame([(n, list(map(signed, r))) for n, r in enumerate(rows)], "n long, prints array<long>")
    half = lambda x, h: x >> 32 * h & 0xFFFFFFFF
    meets = lambda x, y: any((half(p, h) ^ half(q, h)).bit_count() <= 1 for p, q in zip(x, y) for h in (0, 1))
    want = {(a, b) for b in range(len(rows)) for a in range(b) if meets(rows[a], rows[b])}
    assert len(want) >= 64 and {(r.a, r.b) for r in simhash.candidates(texts).collect()} <= want
    keys = {(t, h, half(p, h)) for r in rows for t, p in enumerate(r) for h in (0, 1)}
    apart = {(a, b) for a, b in want if not any(half(p, h) == half(q, h) for p, q in zip(rows[a], rows[b]) for h in (0, 1))}
    got = {(r.a, r.b) for r in simhash.candidates(texts).collect()}
    assert apart <= got and len(keys) > 64  # two texts of one half meet by way of the first of it


# 5
HEADERS = "record_id long, url string, ts long, headers map<string,string>"


def test_revisits(spark):
    full = [(1, "https://www.A.com/x?utm_source=f#t", 10, {"etag": '"a"', "content-length": "5", "date": "1"}), (2, "http://a.com/x/", 20, {"etag": '"b"', "content-length": "6"}), (3, "http://a.com/y", 5, {"last-modified": "m"}), (4, None, 1, {})]
    asked = [(10, "http://a.com/x", 15, {"etag": 'W/"a"', "content-length": "0", "date": "9"}), (11, "http://a.com/x", 25, {"etag": '"a"'}), (12, "http://a.com/y", 6, {"last-modified": "m"}), (13, "http://a.com/y", 5, {"last-modified": "m"}), (14, "http://a.com/y", 9, {"etag": "q"}), (15, None, 9, {}), (10, "http://a.com/x", 15, {"etag": 'W/"a"', "content-length": "0", "date": "9"})]
    got = sorted((r.record_id, r.response_id or 0, r.status, tuple(sorted((r.headers or {}).items()))) for r in revisits.resolve(spark.createDataFrame(asked, HEADERS), spark.createDataFrame(full, HEADERS)).collect())
    first = (10, 1, "resolved", (("content-length", "5"), ("date", "9"), ("etag", 'W/"a"')))
    assert got == [first, first, (11, 2, "changed", ()), (12, 3, "resolved", (("last-modified", "m"),)), (13, 0, "missing", ()), (14, 3, "unverified", ()), (15, 0, "missing", ())]


def test_revisits_of_any_case_of_header_names(spark, empty):
    full = [(1, "http://a.com/x", 10, {"ETag": '"a"', "Content-Length": "5"}), (2, "http://a.com/z", 10, None)]
    asked = [(10, "http://a.com/x", 15, {"etag": '"a"', "ETAG": '"b"', "Date": "9"}), (11, "http://a.com/z", 15, None)]
    left, right = spark.createDataFrame(asked, HEADERS).withColumn("url_key", F.lit("own")), spark.createDataFrame(full, HEADERS).withColumn("full", F.lit("own"))
    got = sorted((r.record_id, r.status, tuple(sorted((r.headers or {}).items()))) for r in revisits.resolve(left, right).collect())
    assert got == [(10, "resolved", (("content-length", "5"), ("date", "9"), ("etag", '"a"'))), (11, "unverified", ())]
    assert revisits.resolve(left.limit(0), right).count() == 0 and {r.status for r in revisits.resolve(left, right.limit(0)).collect()} == {"missing"}


# 6
def mixing_shares(spark, tokens, p, targets):
    """The expected totals by domain, in parts of all, at the rates that the operator finds and at one, and these rates."""
    rows = [(int(n), *map(float, x)) for n, x in zip(tokens, p)]
    members = spark.createDataFrame(rows, "n_tokens long, p_good double, p_low double, p_toxic double")
    steps = mixing.solve(members, targets)
    r = [x.r for x in members.select(mixing.rates(steps, [F.col(f"p_{d}") for d in mixing.DOMAINS]).alias("r"), F.monotonically_increasing_id().alias("at")).orderBy("at").collect()]
    n, p = np.array(tokens, float), np.array(p, float)
    have = n @ p
    want = np.array([targets[d] for d in mixing.DOMAINS])
    return (n * r) @ p, want / want[0] * have[0], np.array(r)


def least_gap(tokens, p, want):
    """The least squared relative gap that rates at or above zero can have: the best of all sets of rates above zero."""
    n, best = np.array(tokens, float), np.inf
    for mask in range(1 << len(n)):
        free = [i for i in range(len(n)) if mask >> i & 1]
        r = np.zeros(len(n))
        r[free] = np.linalg.lstsq((p[free] * n[free, None]).T / want[:, None], np.ones(len(want)), rcond=None)[0]
        if r.min() >= -1e-12:
            best = min(best, float(((((n * r) @ p) / want - 1) ** 2).sum()))
    return best


#: Targets that the posteriors of these tests allow.
ALLOWED = {"good": 0.95, "low": 0.025, "toxic": 0.025}


def test_mixing_meets_feasible_targets(spark):
    pure = [(0.98, 0.01, 0.01), (0.03, 0.95, 0.02), (0.03, 0.02, 0.95)]
    soft = [(0.999, 0.0005, 0.0005), (0.97, 0.02, 0.01), (0.3, 0.6, 0.1), (0.2, 0.1, 0.7), (0.03, 0.95, 0.02), (0.03, 0.02, 0.95)]
    cases = [(pure, [400, 50, 50], {"good": 0.6, "low": 0.2, "toxic": 0.2}), (pure, [995, 3, 2], ALLOWED), (soft, [9000, 800, 90, 60, 30, 20], ALLOWED), (soft, [999_950, 9, 9, 9, 13, 10], {"good": 0.99, "low": 0.008, "toxic": 0.002})]
    for p, tokens, targets in cases:
        got, want, r = mixing_shares(spark, tokens, p, targets)
        assert r.min() >= 0 and np.allclose(got, want, rtol=1e-5, atol=0)


def test_mixing_of_random_posteriors_is_the_exact_optimum(spark):
    rng = np.random.default_rng(3)
    for _ in range(8):
        m = int(rng.integers(2, 8))
        tokens, p = rng.integers(1, 1000, m), rng.dirichlet(np.full(3, rng.choice([0.3, 1.0])), m)
        got, want, r = mixing_shares(spark, tokens, p, ALLOWED)
        assert r.min() >= 0 and float(((got / want - 1) ** 2).sum()) <= least_gap(tokens, p, want) * 1.05 + 1e-6


def test_mixing_posteriors_and_totals(spark):
    """Rows recomputed with numpy from the measures, and the totals that they add up to."""
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = mixing.fit(docs, marks)
    rows = {r.doc_id: r for r in mixing.measured(mixing.features(docs, "text", [F.col("doc_id")]), model.telling).collect()}
    out = mixing.mixed(docs, marks).collect()
    for r in out:
        x = np.array([rows[r.doc_id][m] for m in mixing.MEASURES])
        z = np.array(model.weights) @ x + np.array(model.intercepts)
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.allclose([r.p_good, r.p_low, r.p_toxic], want, atol=1e-9) and r.n_tokens == rows[r.doc_id].n_tokens
    total = np.sum([[r.rate * r.n_tokens * p for p in (r.p_good, r.p_low, r.p_toxic)] for r in out], axis=0)
    wanted = mixing.feasible(spark.createDataFrame([(r.n_tokens, r.p_good, r.p_low, r.p_toxic) for r in out], "n_tokens long, p_good double, p_low double, p_toxic double"), mixing.TARGETS)
    assert np.allclose(total / total.sum(), list(wanted.values()), rtol=1e-2) and wanted["good"] > 0.94
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i in list(rows)[:200]:
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", texts[i].lower())
        assert rows[i].n_tokens == len(w) and abs(rows[i].x_low - math.log1p(len(set(w) & {f for f in model.telling[0] if f[0] != "<"}) + sum(f in model.telling[0] for f in binned(w, texts[i])))) < 1e-9


def binned(w, t):
    n = max(1, len(w))
    return [f"<distinct {10 * len(set(w)) // n}>", f"<marks {min(9, math.ceil(20 * len(re.findall('[#$%&|<>]', t)) / n))}>", f"<calls {min(9, math.ceil(20 * t.count('!') / n))}>"]


def test_mixing_learns_and_keeps_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = mixing.mixed(docs, marks).join(marks, "doc_id").collect()
    clean = [r.copies for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [r.copies for r in rows if r.toxic == 1 or r.quality == 0]
    assert np.mean([c > 0 for c in clean]) > 0.9 and np.mean(bad) < 0.5 * np.mean(clean)


def test_mixing_edges(edge, empty, labels):
    got = mixing.mixed(edge, labels)
    assert got.count() == edge.count() and got.filter("rate < 0 or copies < 0 or rate is null").isEmpty()
    assert mixing.mix(edge, labels).columns == edge.columns
    assert mixing.mixed(empty, labels).count() == 0


def test_mixing_keeps_what_it_cannot_tell_apart(spark, edge, labels):
    """Without labels, with those of one domain, or with null ids or marks only, every document stays once."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    marks = spark.read.parquet(f"{DATA}/labels.parquet")
    good, low = (marks.withColumn("quality", F.lit(q)).withColumn("toxic", F.lit(0)) for q in (1, 0))
    for some, one in ((marks.limit(0), None), (good, "p_good"), (low, "p_low"), (marks.withColumn("doc_id", F.lit(None).cast("long")), None), (marks.withColumn("toxic", F.lit(None).cast("int")), None)):
        rows = mixing.mixed(docs, some).collect()
        assert {(r.rate, r.copies) for r in rows} == {(1.0, 1)}
        assert {(r.p_good, r.p_low, r.p_toxic) for r in rows} == {tuple(float(c == one) for c in ("p_good", "p_low", "p_toxic")) if one else (1 / 3, 1 / 3, 1 / 3)}
        assert mixing.mix(docs, some).count() == docs.count()
    rng = random.Random(2)  # labels that say nothing: most documents stay
    noise = spark.createDataFrame([(r.doc_id, rng.randint(0, 1), rng.randint(0, 1)) for r in docs.collect()], "doc_id long, quality int, toxic int")
    assert mixing.mix(docs, noise).select("doc_id").distinct().count() > 0.7 * docs.count()


def test_copies_of_null_ids_are_dealt_by_text(spark):
    rows = spark.createDataFrame([(None, f"text {k}") for k in range(2000)], "id long, text string")
    times = Counter(r[0] for r in rows.select(mixing.copies(F.col("id"), F.col("text"), F.lit(0.25))).collect())
    assert set(times) == {0, 1} and 400 < times[1] < 600


def test_targets_are_no_smaller_than_what_can_be_told_apart(spark):
    flat = spark.createDataFrame([(10, 0.8, 0.15, 0.05)] * 50, "n_tokens long, p_good double, p_low double, p_toxic double")
    got = mixing.feasible(flat, mixing.TARGETS)
    assert np.allclose([got[d] for d in mixing.DOMAINS], [0.8, 0.15, 0.05])
    told = spark.createDataFrame([(90, 0.999, 0.0005, 0.0005), (8, 0.01, 0.98, 0.01), (2, 0.01, 0.01, 0.98)], flat.schema)
    assert mixing.feasible(told, mixing.TARGETS) == mixing.TARGETS


# 7
def brute_repeats(texts):
    n, count, out = suffix.LENGTH, Counter(), []
    for t in texts:
        count.update(t[s : s + n] for s in range(len(t) - n + 1))
    for t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - n + 1):
            if count[t[s : s + n]] > 1:
                gone[s : s + n] = b"\1" * n
        out.append((len(t), sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), sha(bytes(b for b, g in zip(t, gone) if not g))))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_repeats(spark, edge, edge_rows, empty, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(suffix, "SPLIT", 1)
    rng = random.Random(5)
    base = ["".join(rng.choice("abc ") for _ in range(1200)) for _ in range(4)]
    more = []
    for i in range(60):
        a = rng.randrange(600)
        t = rng.choice(base)[a : a + rng.randint(150, 600)]
        k = rng.randrange(len(t))
        more.append((1000 + i, t[:k] + "X" + t[k + 1 :] if i % 2 else t))
    rows = edge_rows + more + documents(spark)[:60]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter((i, *b) for (i, _), b in zip(rows, brute_repeats([(t or "").encode() for _, t in rows])))
    assert multiset(suffix.remove_repeats(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    if not hot:
        assert suffix.remove_repeats(edge).count() == edge.count() and suffix.remove_repeats(empty).count() == 0


def test_deep_shallow_order():
    rng = random.Random(5)
    for _ in range(100):
        items = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 30))]
        assert [items[i] for i in suffix.deep_shallow(items)] == sorted(items)
        assert [items[i] for i in suffix.blind_trie(items, list(range(len(items))))] == sorted(items)


# 8
def test_exact_dedup(spark, edge, edge_rows, empty):
    norm = [re.sub(WS, "", t or "") for _, t in edge_rows]
    rank = lambda k: (-len(edge_rows[k][1] or ""), edge_rows[k][0])
    want = Counter()
    for k, (i, _) in enumerate(edge_rows):
        same = sorted((j for j in range(len(norm)) if norm[j] == norm[k]), key=rank)
        want[i, edge_rows[same[0]][0], len(same), sha(norm[k])] += 1
    got = exact.exact_dedup(edge)
    assert multiset(got, "doc_id", "keep_id", "group_size", "text_sha256") == want
    assert got.filter("kept").count() == len(set(norm))
    kept = exact.drop_exact_copies(edge)
    assert kept.columns == edge.columns and kept.count() == len(set(norm))
    assert exact.exact_dedup(empty).count() == 0


# 9
E_, I_, C_, P_ = (re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    return [
        [m.span() for m in E_.finditer(t)],
        [m.span() for m in I_.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))],
        [m.span() for m in C_.finditer(t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))],
        [m.span() for m in P_.finditer(t) if 9 <= len(digits(m)) <= 15],
    ]


def test_pii_base_on_random_texts():
    rng = random.Random(2)
    for _ in range(4000):
        t = "".join(rng.choice("ab@@..--++  ()0123456789019x%_") for _ in range(rng.randint(0, 80)))
        assert pii.base_spans(t)[0] == brute_spans(t)


def test_pii(spark, edge, edge_rows, empty):
    want = Counter()
    for i, t in edge_rows + documents(spark):
        spans = brute_spans(t or "")
        want[i, *map(len, spans), sha(",".join(f"{k}:{a}:{b}" for k, s in zip(pii.KINDS, spans) for a, b in s))] += 1
    rows = pii.scan(edge).unionByName(pii.scan(spark.read.parquet(f"{DATA}/documents.parquet")))
    assert multiset(rows, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want
    assert pii.scan(empty).count() == 0 and pii.mask(edge).count() == edge.count()


@pytest.mark.parametrize("key", ["X-Api-Key: ", "Api_Key = ", "ApiKey=", "aPiKeY=", "Pwd=", "pWD: ", "PassWord=", "Token: ", "toKen=", "SecRet="])
def test_pii_secrets_of_any_case(key):
    assert pii.base_spans(f"{key}ABCD1234efgh")[1] == [(4, len(key), len(key) + 12)]
    assert pii.base_spans(f"rapid {key}ABCD1234efgh")[1] == [(4, len(key) + 6, len(key) + 18)]


def test_em_tells_reliable_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    right = (0.95, 0.9, 0.85, 0.6, 0.8)
    said = np.stack([np.where(rng.random(4000) < r, truth, ~truth).astype(int) for r in right], axis=1)
    post, _ = pii.estimate(said, np.ones(4000))
    assert ((post > 0.5) == truth).mean() > 0.95


# 10
def brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark, edge, edge_rows, empty, labels):
    want = Counter((i, *brute_counts(t or "")) for i, t in edge_rows)
    got = quality.judge(edge, labels)
    assert multiset(got, "doc_id", *quality.COUNTS) == want
    for r in got.collect():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    kept = quality.keep_good(edge, labels.limit(0))
    assert kept.columns == edge.columns and kept.count() == got.filter("not base_failed").count()
    assert quality.judge(empty, labels).count() == 0
    for i, t in documents(spark):
        assert quality.measure(t)[:5] == brute_counts(t)


def test_quality_held_out_accuracy(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.fit(docs, marks.filter("doc_id % 2 = 0"))
    measured = quality.with_measures(docs, "text", ["doc_id"])
    m = measured[measured.columns[-1]]
    rows = measured.select("doc_id", quality.base_failed(m).alias("failed"), quality.verdict(rules, m).alias("kept")).join(marks.filter("doc_id % 2 = 1"), "doc_id").collect()
    assert np.mean([r.kept for r in rows if r.quality == 1 and not r.failed]) > 0.98
    assert np.mean([not r.kept for r in rows if r.quality == 0]) > 0.9


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).fetchall()
    cols = [d[0] for d in con.description]
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(cols) == sorted(got.columns)
    assert Counter(map(str, (tuple(r) for r in got.select(*cols).collect()))) == Counter(map(str, want))


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        seen[name] = {r.doc_id for r in out.select("doc_id").collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == spark.read.parquet(f"{sf}/documents.parquet").columns
            docs = out
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    norm = Counter(re.sub(WS, "", texts[i]) for i in seen["exact dedup"])
    assert max(norm.values()) == 1 and set(norm) == {re.sub(WS, "", texts[i]) for i in seen["quality rules"]}
    before, after = sorted(seen["exact dedup"]), seen["SimHash near-dedup"]
    links = [(before[a], before[b]) for a, b in brute_similar([texts[i] for i in before])]
    root = {i: i for i in before}
    find = lambda i: i if root[i] == i else find(root[i])
    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    whole = {min(i for i in before if find(i) == r) for r in {find(i) for i in before}}
    assert whole == after
    assert seen["BPE"] == seen["mixing"] and seen["mixing"] <= seen["SimHash near-dedup"]


def test_pipeline_run_equals_its_stages(spark):
    """run() against each stage's own brute-force or library form, on the rows that the stage before it left."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    sf = DATA
    docs, library = spark.read.parquet(f"{sf}/documents.parquet"), Tokenizer.from_file(queries.vocabulary())
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality.judge(docs, spark.read.parquet(f"{sf}/labels.parquet")).filter("kept").collect()}
    for i in good:
        n, _, _, _, again = brute_counts(texts[i])
        assert n >= 20 and 100 * again <= 30 * n
    best = {}
    for i in sorted(good):
        k = re.sub(WS, "", texts[i])
        best[k] = min(best.get(k, (0, i)), (-len(texts[i]), i)) if k in best else (-len(texts[i]), i)
    unique = spark.createDataFrame([(i, texts[i]) for _, i in best.values()], "doc_id long, text string")
    near = {r.doc_id: r.text for r in simhash.keep_one_similar(unique).collect()}
    assert not {(a, b) for a, b in brute_similar(list(near.values()))}
    rates = mixing.mixed(docs.filter(F.col("doc_id").isin(list(near))), spark.read.parquet(f"{sf}/labels.parquet"))
    want = Counter()
    for r in rates.collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        if r.copies:
            want[r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] = r.copies
    assert multiset(corpus_pipeline.run(spark, sf), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
