"""Quality, SimHash, substring, mixing, packing, toxicity against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cohort_spark.llm import common, mixing, packing, quality, simhash, substring, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, fp int, doc string, hot string, score string, _row int, _doc string, _failed int, _source int, `a.b` int"


def frame(spark, rows):
    """Documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, "y", "z", "w", 1, "v", 2, 3, 4) for i, t, s in rows], SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, edge cases; repeated rows; a null id."""
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(20, 200)) for _ in range(40)]
    passage = prose(rng, 40)
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "s0") for i in range(8)]
    for i in range(8, 20):
        words = base[i].split()
        words[len(words) // 2] = "changed"
        rows.append((200 + i, " ".join(words), "s1"))
    rows += [(300 + i, f"{prose(rng, 15)} {passage}\n{prose(rng, 15)}", "s2") for i in range(6)]
    rows += [(400, None, "s0"), (401, "", None), (402, " \n\t", "s0"), (403, "one", "s0"), (404, "One", "s0"), (405, "a b", "s1"), (406, "é ü x y " * 30, "s1")]
    rows += [(407, prose(rng, 30000), "s1"), (0, base[0], "s0"), (None, base[1], "s0"), (None, "lonely " * 20, None), (408, "same line here now again\n" * 40, "s2"), (5, base[2], "s0"), (5, prose(rng, 30), "s0")]
    return rows


# -- words and hashes ----------------------------------------------------------


def test_words_are_those_of_the_pattern(texts):
    for _, t, _ in texts:
        assert [w.decode() for w in common.split_words(t)] == WORD.findall(t or "")


def thue_morse(flip):
    """1024 letters whose polynomial hashes agree for both values of ``flip``, modulo any power of two up to 64."""
    return "".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(1024))


def test_word_ids_equal_iff_words_equal(texts):
    column = pa.array([*[t for _, t, _ in texts], f"{thue_morse(0)} {thue_morse(1)}"])
    words = [WORD.findall(t or "") for t in column.to_pylist()]
    for most in (1 << 19, 100):
        found = [[tuple(x) for x in ids[:, a:b].T.tolist()] for _, ids, bounds in common.word_runs(column, most=most) for a, b in zip(bounds[:-1], bounds[1:])]
        assert [len(x) for x in found] == [len(x) for x in words]
        by_word = set(zip([w for ws in words for w in ws], [x for xs in found for x in xs]))
        assert len(by_word) == len({w for w, _ in by_word}) == len({x[0] for _, x in by_word}) == len({x[1] for _, x in by_word})


def test_long_texts_are_cut_between_words():
    data = ("ab  é\n" * 1000).encode()
    assert [w for part in common.word_slices(data, 7) for w in part] == data.split()


# -- quality -------------------------------------------------------------------


def brute_signals(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeat = {p for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat)


def test_signals(texts):
    for _, t, _ in texts:
        assert quality.signals(t) == brute_signals(t)
    assert quality.signals("a b c d e a b c d e # <") == brute_signals("a b c d e a b c d e # <")


def test_quality_verdicts(spark, texts):
    rows = texts + [(900 + i, "bad " * 30, "junk") for i in range(60)]
    out = quality.judge_documents(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    wanted = Counter()
    for i, t, s in rows:
        n, c, y, d, r = brute_signals(t)
        wanted[(i, n, r, n < 10 or 100 * r > 20 * n)] += 1
    assert Counter((r.doc_id, r.n_words, r.n_repeat_words, r.base_failed) for r in out) == wanted
    assert all(r.kept == (not r.base_failed and not r.host_rejected) for r in out)
    assert {r.host_rejected for r in out if r.doc_id and r.doc_id >= 900} == {True}
    kept = quality.filter_documents(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in out if r.kept)


def test_host_rates_of_large_counts(spark):
    hosts = spark.createDataFrame([("a", 4 * 10**9, 4 * 10**9), ("b", 9 * 10**18, 10**18), ("c", 10, 0)], "host string, n long, failures long")
    rates = {r.host: r.rate for r in quality.shrunken(hosts.limit(3).where("n < 9e17")).collect()}
    assert rates["a"] > 0.99 and rates["c"] < 0.9
    assert abs({r.host: r.rate for r in quality.shrunken(hosts).collect()}["b"] - 1 / 9) < 1e-3


def test_small_hosts_follow_the_overall_rate(spark):
    rows = [(f"h{h}", h % 10 == 0 and i == 0) for h in range(100) for i in range(5)] + [("tiny", True)]
    rates = {r.host: r.rate for r in quality.host_rates(spark.createDataFrame(rows, "host string, failed boolean")).collect()}
    assert rates["tiny"] < 0.5


def test_quality_of_nothing(spark):
    assert quality.judge_documents(frame(spark, [])).count() == 0
    assert quality.filter_documents(frame(spark, [])).count() == 0


# -- simhash -------------------------------------------------------------------


def brute_simhash(text, k=3):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = WORD.findall((text or "").translate(lower))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_simhash(texts):
    for _, t, _ in texts:
        assert simhash.simhash(t) == brute_simhash(t)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 6, 8])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 6, np.uint64)
    prints = np.unique(np.concatenate([base ^ np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, 6).astype(np.uint64) for _ in range(k)]) for k in range(1, 9)] + [base]))
    root = {i: i for i in range(len(prints))}
    wanted = brute_components(list(range(len(prints))), lambda a, b: (int(prints[a]) ^ int(prints[b])).bit_count() <= radius)
    small = [np.array([7], np.uint64), *np.array_split(rng.permutation(prints), 9), np.array([1, 2, 3], np.uint64), rng.permutation(prints)[:64]]
    lists = [*small[:4], prints, np.concatenate([prints, ~prints, prints * np.uint64(3)]), *small[4:]]
    for own, near in zip(lists, simhash.adjacencies(lists, radius), strict=True):
        linked = np.bitwise_count(own[:, None] ^ own[None, :]) <= radius
        np.fill_diagonal(linked, False)
        found = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little").astype(bool)
        assert (found[:, : len(own)] == linked).all() and not found[:, len(own) :].any()
        if own is prints:
            for a, b in simhash.local_links(near):
                root[b] = a
            assert {i: wanted[i] for i in root} == root


def test_keys_grow_with_the_number_of_fingerprints():
    assert simhash.tables_for(3, 1000) == (4, 1) and simhash.tables_for(3, 10**7) == (5, 2) and simhash.tables_for(3, 10**11)[0] > 6
    for radius in range(65):
        for n in (10, 10**6, 10**12):
            blocks, agree = simhash.tables_for(radius, n)
            assert blocks - agree >= radius or radius == 64


def test_near_pairs_are_within_the_radius_and_miss_no_row(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(63) for _ in range(20)]
    prints = sorted({p ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(4))) for p in base for _ in range(8)})
    pairs = [(r.a, r.b) for r in simhash.near_pairs(spark.createDataFrame([(p,) for p in prints], "fp long"), 6, 16).collect()]
    assert all((a ^ b).bit_count() <= 6 and a != b for a, b in pairs)
    near = {p for p in prints for q in prints if p != q and (p ^ q).bit_count() <= 6}
    assert {x for pair in pairs for x in pair} == near


def test_radius_search_is_exact(spark):
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for p in list(prints)[:120]:
        for _ in range(2):
            q = p
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                q ^= 1 << b
            prints.add(q)
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    for radius, block in ((3, 2048), (6, 8)):
        found = {r.node: r.root for r in simhash.components(simhash.fingerprint_links(df, radius, block)).collect()}
        wanted = brute_components(sorted(signed), lambda a, b, r=radius: (signed[a] ^ signed[b]).bit_count() <= r)
        assert {n: found.get(n, n) for n in signed} == wanted


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(64)] + [(100, 101), (5, 5)], "a long, b long")
    assert {r.node: r.root for r in simhash.components(edges).collect()} == {**{i: 0 for i in range(65)}, 100: 100, 101: 100}


def test_near_duplicates(spark, texts):
    rows = texts
    out = simhash.near_duplicates(frame(spark, rows)).collect()
    prints = [brute_simhash(t) for _, t, _ in rows]
    comp = brute_components(list(range(len(rows))), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    least = defaultdict(list)
    for k, c in comp.items():
        if rows[k][0] is not None:
            least[c].append(rows[k][0])
    wanted = Counter((rows[k][0], f"{prints[k]:016x}", min(least[comp[k]], default=None)) for k in range(len(rows)))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in out) == wanted


def test_near_dedup_keeps_one_of_each_group(spark, texts):
    rows = texts
    docs = frame(spark, rows)
    kept = simhash.deduplicated(docs, radius=6)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    shingles = lambda t: {tuple((t or "").lower().split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))}
    sets, prints = [shingles(t) for _, t, _ in rows], [brute_simhash(t) for _, t, _ in rows]
    alike = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 6 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    comp = brute_components(list(range(len(rows))), lambda a, b: (rows[a][1] or "") == (rows[b][1] or "") or alike(a, b))
    groups = defaultdict(list)
    for k, c in comp.items():
        groups[c].append((rows[k][0] is None, rows[k][0]))
    assert Counter(ids) == Counter(min(g)[1] for g in groups.values())
    assert simhash.deduplicated(frame(spark, [])).count() == 0


def test_near_dedup_of_a_chain_and_a_dense_group(spark):
    rng = random.Random(8)
    words = prose(rng, 300).split()
    rows = []
    for i in range(60):  # every text differs from the first in one word: all near one another
        own = list(words)
        own[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(own), "s"))
    rows += [(100 + i, prose(rng, 80), "s") for i in range(40)]
    ids = sorted(r.doc_id for r in simhash.deduplicated(frame(spark, rows)).collect())
    assert ids == [0, *range(100, 140)]


def by_jaccard(rows):
    """Ids that stay if all pairs of at least 0.8 link, whatever their fingerprints."""
    shingles = lambda t: {tuple((t or "").lower().split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))}
    sets = [shingles(t) for _, t, _ in rows]
    comp = brute_components(list(range(len(rows))), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    return sorted({min(rows[j][0] for j, d in comp.items() if d == c) for c in set(comp.values())})


@pytest.mark.parametrize("fruitful", [0.0, 1e9])
def test_near_dedup_finds_pairs_beyond_the_radius(spark, fruitful, monkeypatch):
    monkeypatch.setattr(simhash, "FRUITFUL", fruitful)
    monkeypatch.setattr(simhash, "PAIRS_A_ROW", 0)
    rng = random.Random(12)
    rows, far = [], 0
    for i in range(0, 300, 3):
        words = prose(rng, rng.randrange(40, 120), 5000).split()
        rows.append((i, " ".join(words), "s"))
        for j in (1, 2):
            own = list(words)
            for _ in range(rng.randrange(1, 4)):
                own[rng.randrange(len(own))] = f"x{rng.random()}"
            rows.append((i + j, " ".join(own), "s"))
            far += (brute_simhash(rows[i][1]) ^ brute_simhash(rows[i + j][1])).bit_count() > 6
    rows += [(400, "", "s"), (401, " ", "s"), (402, "A b", "s"), (403, "a  B", "s"), (404, "a b c", "s")]
    assert far > 20
    kept = sorted(r.doc_id for r in simhash.deduplicated(frame(spark, rows), radius=None).collect())
    assert kept == by_jaccard(rows)


def test_dealt_counts_add_up():
    rng = np.random.default_rng(2)
    for share in (0, 0.01, 0.15, 0.2, 1):
        counts = (rng.random(simhash.COUNTS_AT_ONCE) < share) * rng.integers(1, 400, simhash.COUNTS_AT_ONCE).astype(np.uint32)
        counts[:2] *= np.uint32(1 << 20)
        low, at, more = simhash.dealt(counts.astype(np.uint32))
        assert len(low) in (0, len(counts)) and len(low) + len(at) + len(more) <= 2 * len(counts) + 6 * (counts > 255).sum()
        total = np.zeros(len(counts), np.int64)
        total += np.frombuffer(low, np.uint8) if low else 0
        total[np.frombuffer(at, np.uint16)] += np.frombuffer(more, np.uint32)
        assert (total == counts).all()


def test_shingle_counts(spark, texts, monkeypatch):
    monkeypatch.setattr(simhash, "COUNTS_AT_ONCE", 64)
    rows = frame(spark, texts * 3).select("text").repartition(5)
    found = simhash.shingle_counts(rows, 5, 1 << 12)
    wanted = Counter()
    for _, h in simhash.shingle_hashes(pa.array([t for _, t, _ in texts] * 3, pa.string()), 5):
        wanted.update((h % np.uint64(1 << 12)).tolist())
    assert found.sum() > 0 and {i: int(n) for i, n in enumerate(found) if n} == dict(wanted)


def test_near_dedup_looks_past_the_nearest_and_smallest_neighbour(spark, monkeypatch):
    rng = random.Random(3)
    words = prose(rng, 100, 5000).split()
    near = [*words[:50], "other", *words[51:]]
    rows = [(1, " ".join(words), "s"), (2, prose(rng, 100, 5000), "s"), (3, " ".join(near), "s")]
    prints = {1: 1, 2: 0, 3: 2}  # text 2 is nearer to both, and smaller
    by_text = F.coalesce(*[F.when(F.md5("u1") == hashlib.md5(t.encode()).hexdigest(), F.lit(prints[i]).cast("long")) for i, t, _ in rows])
    monkeypatch.setattr(simhash, "with_fingerprint", lambda docs, text, name: docs.withColumn(name, by_text))
    assert sorted(r.doc_id for r in simhash.deduplicated(frame(spark, rows)).collect()) == [1, 2]


# -- substring -----------------------------------------------------------------


def brute_kept(rows, k=13):
    """(words, places removed) of each row."""
    first = {}
    big = 1 << 63
    own = [big if i is None else i for i, _, _ in rows]
    words = [WORD.findall(t or "") for _, t, _ in rows]
    for i, w in zip(own, words):
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            first[key] = min(first.get(key, i), i)
    return [(w, {q for p in range(len(w) - k + 1) if first[tuple(w[p : p + k])] < i for q in range(p, p + k)}) for i, w in zip(own, words)]


def brute_substring(rows, k=13):
    out = []
    for (doc, _, _), (w, gone) in zip(rows, brute_kept(rows, k)):
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def check_substring(spark, rows):
    docs = frame(spark, rows)
    out = substring.deduplicated(docs)
    assert out.columns == [*docs.columns, "_dedup"]
    found = Counter((r.doc_id, r._dedup.n_words, r._dedup.n_removed, r._dedup.kept_sha256) for r in out.collect())
    assert found == brute_substring(rows)


def test_substring(spark, texts):
    check_substring(spark, texts)


def test_substring_where_paths_branch(spark):
    """Passages that share parts, follow one another in several orders, and repeat within a text."""
    rng = random.Random(8)
    parts = [prose(rng, rng.randrange(5, 40), 5000) for _ in range(8)]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))), "s") for i in rng.sample(range(1000), 60)]
    rows += [(2000 + i, " ".join(["again"] * rng.randrange(10, 60)), "s") for i in range(5)]
    check_substring(spark, rows)


def test_substring_where_many_rows_have_no_id(spark):
    rng = random.Random(9)
    passage = prose(rng, 60, 5000)
    rows = [(None, f"{prose(rng, 20, 5000)} {passage}", "s") for _ in range(200)] + [(None, passage, "s")] * 50
    rows += [(7, f"{passage} {prose(rng, 20, 5000)}", "s"), (None, None, "s"), (None, "", "s")]
    check_substring(spark, rows)
    check_substring(spark, [r for r in rows if r[0] is None])  # none has an id: none yields


def test_substring_tells_words_of_equal_polynomial_hashes_apart(spark):
    tail = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{thue_morse(0)} {tail}", "s"), (2, f"{thue_morse(1)} {tail}", "s"), (3, f"{thue_morse(1)} {tail}!", "s")]
    check_substring(spark, rows)
    assert {r._dedup.n_removed for r in substring.deduplicated(frame(spark, rows)).collect()} == {0}


def test_substring_removes_nothing_unverified(spark, monkeypatch):
    """Were two windows' keys equal, their words would still differ."""
    monkeypatch.setattr(substring, "rolled", lambda words, k, base=3: np.full(max(0, len(words) - k + 1), 5, np.uint64))
    monkeypatch.setattr(substring, "_minimizers", lambda words, k, run: np.full(max(0, len(words) - k + 1), 7, np.uint64))
    rng = random.Random(2)
    rows = [(i, prose(rng, 13, 5000), "s") for i in range(4)]
    assert {r._dedup.n_removed for r in substring.deduplicated(frame(spark, rows)).collect()} == {0}


def test_substring_replaces_a_column_of_its_name(spark):
    docs = frame(spark, [(1, "a b", "s")]).withColumn("_dedup", F.lit(1))
    out = substring.deduplicated(docs)
    assert out.columns == docs.columns and out.first()._dedup.n_words == 2
    assert substring.deduplicated(docs, name="cut").columns == [*docs.columns, "cut"]


def test_substring_of_nothing(spark):
    assert substring.deduplicated(frame(spark, [])).count() == 0


# -- mixing --------------------------------------------------------------------


def test_mixing_approaches_weights(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 40), f"s{min(2, i % 7)}") for i in range(3000)]
    out = mixing.mixed_documents(frame(spark, rows), {"s0": 3.0, "s1": 1.0}, default=1.0)
    sizes = {r.source: r.n for r in out.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    total = sum(sizes.values())
    assert abs(sizes["s0"] / total - 0.6) < 0.06 and abs(sizes["s1"] / total - 0.2) < 0.04
    again = mixing.mixed_documents(frame(spark, rows).repartition(7), {"s0": 3.0, "s1": 1.0}, default=1.0)
    assert Counter((r.doc_id, r._copy) for r in out.collect()) == Counter((r.doc_id, r._copy) for r in again.collect())


def brute_counts(rows, weights, default, seed=17):
    """How often each row is drawn, from the definition."""
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t or "")
    weight = {s: weights.get(s, default) if n else 0.0 for s, n in size.items()}
    total = sum(weight.values())
    out = Counter()
    for i, t, s in rows:
        rate = weight[s] * sum(size.values()) / (total * size[s]) if total and size[s] else 0.0
        draws = max(1, -int(-rate // mixing.MEAN_STEP))
        key = f"text:{hashlib.sha256((t or '').encode()).hexdigest()}" if i is None else str(i)
        n = 0
        for d in range(1, draws + 1) if rate else ():
            u = int(hashlib.md5(f"{seed}:{key}:{d}".encode()).hexdigest()[:13], 16) / (1 << 52)
            p = c = math.exp(-rate / draws)
            for k in range(1, mixing.TABLE + 2):
                n += c <= u
                p *= rate / draws / k
                c += p
        out[(i, t)] += n
    return +out


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e7])
def test_mixing_counts(spark, texts, scale):
    weights = {"s0": 0.4, "s1": 20.0, "s2": 1.0}
    out = mixing.mixed_documents(frame(spark, texts), {s: w * scale for s, w in weights.items()}, default=scale)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == brute_counts(texts, weights, 1.0)


def test_mixing_edge_cases(spark, texts, monkeypatch):
    monkeypatch.setattr(mixing, "PARTITION_CHARS", 20_000)
    out = mixing.mixed_documents(frame(spark, texts), {"s0": 0.0, "s1": 200.0}, epochs=3.0)
    assert "s0" not in {r.source for r in out.select("source").distinct().collect()}
    keys = [r._shuffle for r in out.collect()]
    assert keys == sorted(keys) and out.rdd.getNumPartitions() > 4
    assert mixing.mixed_documents(frame(spark, []), {}).count() == 0
    clash = frame(spark, texts).withColumn("_rate", F.lit("own"))
    assert mixing.mixed_documents(clash, {}).columns.count("_rate") == 1
    assert mixing.mixed_documents(clash, {}, prefix="x").columns == [*clash.columns, "xrate", "xcopy", "xshuffle"]


# -- packing -------------------------------------------------------------------


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_chunked_ids_equal_whole_ids(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary())
    odd = ["a b c", "x\x1cy\x85z", "İstanbul ΣΑΣ ﬁ é ́a", "it's I'll 12a3 <|endoftext|> a<|startoftext|>b", "﻿ a​b", "emoji 👩‍👩‍👧 end"]
    cases = [t for _, t, _ in texts if t] + odd
    wanted = [whole.encode(t, add_special_tokens=False).ids for t in cases]
    assert [np.frombuffer(raw, "<u4").tolist() for raw in packing.WordTokenizer(vocabulary()).ids(cases)] == wanted


def test_ids_of_random_strings_equal_whole_ids():
    from tokenizers import Tokenizer

    whole, pick = Tokenizer.from_file(vocabulary()), random.Random(12)
    parts = [*"abzAZÀéßİıŞşĞğŁøŒœŸÿªº·ſŉǅǆΑΣςσωέЖж中文字かな한글अआ", *".,.,.,'’!?-\"0189½²٣", *"\u0301\u0307\u0308\u0327\u0345\u00ad\u200b\u200d\ufeff\u0130", *"  \t\n\x0b\x1c\x85\u00a0\u2003", "<|endoftext|>", "<|startoftext|>", "the", "İ.", "it's", "ﬁ", "👩", "🏽", "Yılmaz", "ÇOK."]
    cases = ["".join(pick.choice(parts) for _ in range(pick.randrange(1, 14))) for _ in range(100_000)]
    wanted = [e.ids for e in whole.encode_batch(cases, add_special_tokens=False)]
    found = packing.WordTokenizer(vocabulary()).ids(cases)
    wrong = [c for c, w, f in zip(cases, wanted, found, strict=True) if np.frombuffer(f, "<u4").tolist() != w]
    assert not wrong, wrong[:5]


def test_ids_with_a_small_memo_and_cut_texts(texts, monkeypatch):
    whole = list(packing.WordTokenizer(vocabulary()).ids([t for _, t, _ in texts]))
    monkeypatch.setattr(packing, "MEMO_BYTES", 5000)
    monkeypatch.setattr(packing, "CHARS", 300)
    monkeypatch.setattr(packing.text_slices, "__defaults__", (300,))
    own = packing.WordTokenizer(vocabulary())
    assert list(own.ids([t for _, t, _ in texts])) == whole
    assert own.size < 200_000


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(spark, texts, capacity, monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary())
    monkeypatch.setattr(packing, "RANK_ROWS", 20)
    out = packing.packed_documents(frame(spark, texts), vocabulary(), capacity=capacity).collect()
    narrow = packing.packed_documents(frame(spark, texts), vocabulary(), capacity=capacity, with_ids=False)
    assert "ids" not in narrow.columns and Counter(narrow.collect()) == Counter(tuple(r[:-1]) for r in out)
    assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in out)
    ids = lambda r: np.frombuffer(bytes(r.ids), "<u4").tolist()
    wanted = Counter(tuple(whole.encode(t or "", add_special_tokens=False).ids + [1]) for _, t, _ in texts)
    by = defaultdict(list)
    for r in out:
        assert len(ids(r)) == r.length <= capacity
        by[(r.doc_id, r.doc_tokens)].append(r)
    total = sum(len(k) * n for k, n in wanted.items())
    assert sum(r.length for r in out) == total
    assert Counter(i for r in out for i in ids(r)) == Counter(i for k, n in wanted.items() for i in list(k) * n)
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity


def test_patterns_place_every_piece_once():
    rng = random.Random(3)
    for _ in range(20):
        histogram = {rng.randrange(1, 101): rng.randrange(1, 300) for _ in range(rng.randrange(1, 60))}
        fill = defaultdict(list)
        for r in packing.plan_patterns(histogram, 100):
            for rank in range(r["rank"], r["until"]):
                into = rank - r["rank"]
                fill[r["first"] + into // r["per"]].append((r["offset"] + into % r["per"] * r["length"], r["length"]))
        assert Counter(n for x in fill.values() for _, n in x) == Counter(histogram)
        for pieces in fill.values():
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
            assert at <= 100


def test_packing_nothing(spark):
    assert packing.packed_documents(frame(spark, []), vocabulary()).count() == 0


# -- pipeline ------------------------------------------------------------------


def brute_pipeline(rows):
    """Pieces (doc_id, start, length, doc_tokens, ids_crc32) of the five stages, each by its definition."""
    from tokenizers import Tokenizer

    failed = [n < 10 or 100 * r > 20 * n for n, _, _, _, r in (brute_signals(t) for _, t, _ in rows)]
    hosts = Counter(s for _, _, s in rows)
    bad = Counter(s for (_, _, s), f in zip(rows, failed) if f)
    mean = sum(failed) / len(rows)
    between = sum(bad[s] ** 2 / n for s, n in hosts.items()) - len(rows) * mean**2 - (len(hosts) - 1) * mean * (1 - mean)
    weight = max(1e-3, min(1000.0, mean * (1 - mean) * len(rows) / between - 1)) if between > 0 else 1000.0
    rejected = {s for s, n in hosts.items() if (bad[s] + mean * weight) / (n + weight) > 0.5}
    assert rejected
    rows = [r for r, f in zip(rows, failed) if not f and r[2] not in rejected]

    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for _, t, _ in rows)]
    comp = brute_components(list(range(len(rows))), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    best = {}
    for k, c in comp.items():
        best[c] = min(best.get(c, k), k, key=lambda j: (rows[j][0] is None, rows[j][0] or 0))
    rows = [rows[k] for k in sorted(best.values())]

    cut = [(i, " ".join(x for q, x in enumerate(w) if q not in gone) if gone else t, s) for (i, t, s), (w, gone) in zip(rows, brute_kept(rows))]
    assert any(a[1] != b[1] for a, b in zip(rows, cut))

    whole, out = Tokenizer.from_file(vocabulary()), Counter()
    for (i, t), n in brute_counts(cut, mixing.WEIGHTS, 1.0).items():
        ids = [*whole.encode(t, add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 2048):
            part = ids[at : at + 2048]
            out[(i, at, len(part), len(ids), zlib.crc32(np.array(part, "<u4").tobytes()))] += n
    return out


def test_pipeline_equals_brute_force(spark, texts, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    rows = [(i, t, s and s.replace("s", "src")) for i, t, s in texts]
    rows += [(900 + i, prose(rng, 5), "junk") for i in range(40)] + [(950, prose(rng, 60), "junk")]
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.start, r.length, r.doc_tokens, r.ids_crc32) for r in out) == brute_pipeline(rows)
    fill = defaultdict(list)
    for r in out:
        fill[r.sequence_id].append((r.offset, r.length))
    assert sorted(fill) == list(range(len(fill)))
    for places in fill.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    docs = frame(spark, [])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


# -- toxicity ------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.25
        words = prose(rng, 60).split()
        if bad:
            words.insert(rng.randrange(60), rng.choice(["blockhead", "Numbskull"]))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(bad)))
    docs = frame(spark, rows + [(5000, None, "s"), (5001, "", None), (None, "blockhead " * 3, "s")])
    known = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.scored(docs, toxicity.fit_on(docs, known)).collect()}
    assert len(out) == 903
    held = [(out[i].predicted, t) for i, _, t in labels if out[i].held_out]
    assert len(held) > 100 and np.mean([p == t for p, t in held]) > 0.95
    assert 0 <= out[5000].score == out[5001].score <= 1 and out[5000].predicted == 0
    assert out[None].predicted == 1 and out[None].held_out is False


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "a b", "s")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scored(docs, toxicity.fit_on(docs, none)).first().score == 0.5
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.scored(docs, toxicity.fit_on(docs, one)).first().score > 0.5


def gram_buckets(text):
    """Buckets of a text's character 3- to 5-grams, in plain integers."""
    points = [32 if ord(c) < 33 else ord(c) for c in f" {text.lower()} "] if text else []
    out, most = set(), 1 << 64
    for n in (3, 4, 5):
        for i in range(len(points) - n + 1):
            h = 0
            for p in points[i : i + n]:
                h = (h * 0x100000001B3 + p) % most
            h = (h + n) % most
            for _ in range(2):
                h ^= h >> 32
                h = h * 0xD6E8FEB86659FD93 % most
            out.add((h ^ (h >> 32)) >> 44)
    return out


def test_toxicity_by_brute_force(spark):
    rng = random.Random(11)
    rows, labels = [], {}
    for i in range(400):
        labels[i] = int(rng.random() < 0.3)
        words = prose(rng, 30).split() + [rng.choice(["blockhead", "Numb\tskull"])] * labels[i]
        rows.append((i, " ".join(words), "s"))
    long = " ".join(f"w{i % 400}" for i in range(60_000))
    rows += [(900, long, "s"), (901, long + " blockhead", "s"), (902, "", "s"), (903, None, "s"), (7, rows[7][1], "s"), (904, "Ünïcode \U0001f600 blockhead", "s")]
    docs = frame(spark, rows)
    model = toxicity.fit_on(docs.where("doc_id < 900").dropDuplicates(["doc_id"]), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    train = [(gram_buckets(t), labels[i]) for i, t, _ in rows[:400] if not held(i)]
    pos, neg = sum(y for _, y in train), sum(1 - y for _, y in train)
    counts = defaultdict(lambda: [0, 0])
    for found, y in train:
        for g in found:
            counts[g][y] += 1
    ratio = {g: math.log((p + 1) / (pos + 2)) - math.log((q + 1) / (neg + 2)) for g, (q, p) in counts.items()}
    features = {g for g, (q, p) in counts.items() if p + q >= 3 and abs(ratio[g]) / math.sqrt(1 / (p + 1) + 1 / (q + 1)) >= toxicity.LEAST_Z}
    assert features and set(np.flatnonzero(model.weights).tolist()) <= features
    weight = {g: float(model.weights[g]) for g in features}
    z = lambda found: model.bias + sum(weight[g] for g in found & features)
    # the fit is a minimum: mean log loss over scaled features, ridge on their coefficients
    slope, bias_slope = defaultdict(float), 0.0
    for found, y in train:
        off = (1 / (1 + math.exp(-z(found))) - y) / len(train)
        bias_slope += off
        for g in found & features:
            slope[g] += off * ratio[g]
    assert abs(bias_slope) < 1e-3 and all(abs(slope[g] + 1e-3 * weight[g] / ratio[g]) < 1e-3 for g in features)
    out = toxicity.scored(docs, model).collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, _, _ in rows)
    texts = {i: t for i, t, _ in rows}
    for r in out:
        want = 1 / (1 + math.exp(-z(gram_buckets(texts[r.doc_id]))))
        assert math.isclose(r.score, want, rel_tol=1e-4, abs_tol=1e-6)
        assert r.predicted == int(r.score >= 0.5) and r.held_out == held(r.doc_id)
    by = {r.doc_id: r.predicted for r in out}
    assert (by[900], by[901], by[902], by[903], by[904]) == (0, 1, 0, 0, 1)
    assert toxicity.scored(docs.limit(0), model).count() == 0
