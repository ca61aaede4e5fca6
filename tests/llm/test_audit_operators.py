"""Filter interaction audit, phrase mining and decontamination against brute force."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from cohort_spark.llm import decontamination, interactions, phrases


# -- filter interaction audit -----------------------------------------------------


def prose(n, step=1):
    return " ".join(f"w{i * step}" for i in range(n))


SHOUT = "ABCDEFGHIJ " * 20 + prose(150)
AUDITED = [
    # id, text, lang
    (1, prose(120), "en"),
    (2, prose(120), "en"),
    (2, prose(120), "de"),
    (3, None, "en"),
    (4, "", None),
    (5, "", None),
    (6, SHOUT, "de"),
    (7, "same " * 200, "de"),
    (8, "same " * 200 + "#", "en"),
    (9, prose(99), ""),
    (10, prose(100), ""),
    (None, prose(120), "en"),
    (None, prose(120), None),
    (None, "x | y", "de"),
    (11, "\x0b\tone\x1c two\x0c", "en"),
    (12, "only\nfew words & more", "en"),
    (13, "only\nfew words & more", "en"),
    (13, "only\nfew words & more", "en"),
    (14, prose(30000, 7) + " " + prose(30000, 7), "fr"),
    (0, SHOUT, "fr"),
    (15, " \n ", "fr"),
    (16, "É" * 50 + " " + "A" * 6, "fr"),
]
MARKS = [(1, 1, 0), (2, 1, 1), (4, 0, 1), (6, 1, None), (7, 0, 0), (9, None, None), (13, 1, 0), (13, 0, 1), (None, 1, 1), (99, 1, 1)]


def audit_by_hand(rows, marks):
    good, toxic = ({i for i, *m in marks if i is not None and m[k] == 1} for k in (0, 1))
    judged = []
    for doc, text, lang in rows:
        t = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = doc is not None and any(o is not None and o < doc and (u or "") == t for o, u, _ in rows)
        fails = {"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy}
        judged.append((lang or "", {k for k, v in fails.items() if v}, doc in good, doc in toxic))
    out, removed = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for step, x in enumerate(order):
            for part in {p for p, *_ in judged}:
                own = [r for r in judged if r[0] == part]
                left = [r for r in own if not r[1] & set(order[:step])]
                here = [r for r in left if x in r[1]]
                removed[part, x] += len(here)
                out[part, order, step + 1] = [len(left) - len(here), len(here), sum(x in r[1] for r in own) - len(here), sum(r[1] == {x} for r in own), sum(r[2] for r in here), sum(r[3] for r in here)]
    return {(p, o, s): (*v, removed[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_interaction_audit_equals_brute_force(spark):
    docs = spark.createDataFrame(AUDITED, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("part", "id", "digest", "mask", "n", "good", "A", "_words", "_id")})
    labels = spark.createDataFrame(MARKS, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    found = interactions.interaction_audit(docs.repartition(5), labels).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found} == audit_by_hand(AUDITED, MARKS)
    assert len(found) == 600 * 4


def test_interaction_audit_of_empty_tables(spark):
    labels = spark.createDataFrame(MARKS, "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert interactions.interaction_audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a", "en")], docs.schema)
    assert interactions.interaction_audit(one, labels.limit(0)).where("removed = 1").count() == 120


def test_packed_fields_do_not_run_over(spark):
    counts = spark.createDataFrame([("x", 0, False, False, 2**62)] * 3 + [("x", 31, True, True, 5)], "part string, mask int, good boolean, toxic boolean, n long")
    total = interactions.packed_sums(counts.repartition(3)).first()
    raw = interactions.fields(int.from_bytes(total.packed, "little"), 3000)
    assert raw[:5] == [3 * 2**62, 5, 0, 5, 5] and raw[5:10] == [3 * 2**62, 0, 5, 0, 0]
    assert max(raw) == 3 * 2**62


@pytest.mark.parametrize("mask", range(32))
def test_packed_outcome_removes_each_failing_row_once(mask):
    raw = interactions.fields(interactions.packed_outcome(mask, True, False), 3000)
    for i in range(0, 3000, 25):
        assert sum(raw[i + 1 : i + 25 : 5]) == (mask > 0) and raw[i + 20] == (mask == 0)


# -- decontamination ----------------------------------------------------------------


def decontamination_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination_by_hand(rows, items, window=10):
    out = []
    for doc, text in rows:
        ws, hit, listed = decontamination_words(text), set(), set()
        for item, t in items:
            own = decontamination_words(t)
            w = min(window, len(own))
            for i in range(len(own) - w + 1 if own else 0):
                for j in range(len(ws) - w + 1):
                    if ws[j : j + w] == own[i : i + w]:
                        hit |= set(range(j, j + w))
                        listed.add(item)
        listed = sorted(str(x) for x in listed - {None})
        out.append((doc, len(ws), len(hit), listed, bool(hit)))
    return sorted(out, key=repr)


PASSAGE = "The quick brown fox, jumps over 13 lazy dogs and Ünder the old bridge at night while we sleep"
ITEMS = [
    (7, PASSAGE),
    (30, PASSAGE),
    (7, "again again again again again again again again again again again"),
    (100, "short item"),
    (101, "!"),
    (102, ""),
    (103, None),
    (None, "nameless words"),
    (104, "a b a b a b a b a b a b"),
    (105, "never seen words of an item that no document has at all"),
    (106, "the the the the the the the the the the"),
]
CHECKED = [
    (1, "so " + PASSAGE.upper().replace("Ü", "ü") + " so"),
    (2, "the quick brown fox jumps over 13 lazy dogs"),
    (2, "x the quick brown fox jumps over 13 lazy dogs and"),
    (3, None),
    (4, ""),
    (5, "...!"),
    (6, "short-item, then nameless\x00words; SHORT\nitem"),
    (None, "short item"),
    (None, "nothing"),
    (7, "b a b a b a b a b a b a b a b"),
    (8, "again " * 30 + "other " + "again " * 9),
    (9, "the " * 500 + "a b " * 300 + PASSAGE),
    (10, ("filler words of a long text " * 40 + PASSAGE + " ") * 6 + "short item"),
    (11, "ends with short"),
    (12, "item starts"),
    (13, "ünder the old bridge at night while we sleep"),
    (14, "dogs and ünder the old bridge at night while we sleep"),
    (15, "the quick brown fox jumps over 13 lazy cats and ünder the old bridge at night while we sleep"),
]


@pytest.mark.parametrize("segment_words, parts", [(100, 1), (100, 4), (1 << 20, 3)])
def test_contamination_equals_brute_force(spark, monkeypatch, segment_words, parts):
    monkeypatch.setattr(decontamination.positional_index, "__defaults__", ("doc_id", "text", segment_words))
    monkeypatch.setattr(decontamination, "ALIGNMENTS", 50)
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 20)
    docs = spark.createDataFrame(CHECKED, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("row", "item", "rows", "ids", "segment", "id", "item_id")})
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({c: F.lit("clash") for c in ("doc_id", "query", "words")})
    found = decontamination.contamination(docs.repartition(parts), items).collect()
    assert sorted((tuple(r) for r in found), key=repr) == contamination_by_hand(CHECKED, ITEMS)


def test_contamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame(CHECKED, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.contamination(docs.limit(0), items).count() == 0
    assert decontamination.contamination(docs, items.limit(0)).where("not contaminated and n_hit = 0 and size(items) = 0").count() == len(CHECKED)


def test_contamination_of_random_texts(spark):
    pick = random.Random(5)
    text = lambda n, k: " ".join(pick.choice("abcdefgh"[:k]) for _ in range(n))
    rows = [(i, text(pick.randrange(60), pick.choice((2, 3, 8)))) for i in range(120)]
    items = [(i, text(pick.randrange(16), pick.choice((2, 3)))) for i in range(25)]
    found = decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=4).collect()
    assert sorted((tuple(r) for r in found), key=repr) == contamination_by_hand(rows, items, 4)


def test_proximity_matches_equal_brute_force(spark):
    pick = random.Random(6)
    rows = [(i, " ".join(pick.choice("abcdefgh") for _ in range(pick.randrange(1, 150)))) for i in range(40)]
    queries = [(0, "a b c"), (1, "h h a"), (2, "a"), (3, "a zz"), (4, "c b a d")]
    for segment_words in (100, 1 << 20):
        index = decontamination.positional_index(spark.createDataFrame(rows, "doc_id long, text string"), segment_words=segment_words)
        words = decontamination.query_words(spark.createDataFrame(queries, "item_id long, text string"))
        found = sorted((r.id, r.item, r.start, r.until) for r in decontamination.proximity_matches(index, words, 6).collect())
        wanted = []
        for doc, text in rows:
            ws = text.split()
            for item, q in queries:
                need, spans = set(q.split()), []
                for s in range(len(ws)):
                    u = next((u for u in range(s + 1, min(len(ws), s + 6) + 1) if need <= set(ws[s:u])), None)
                    if u and not any(need <= set(ws[s2:u]) for s2 in range(s + 1, u)):
                        spans.append((doc, item, s, u))
                wanted += spans
        assert found == sorted(wanted) and found
    with pytest.raises(ValueError):
        decontamination.proximity_matches(index, words, 1000)


# -- phrase mining ------------------------------------------------------------------


def collocations_by_hand(rows, longest=3, least=10, top=2000, covered=50):
    f, total = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und" if lang != "" else ""] += len(ws)
            for k in range(1, longest + 1):
                f.update((lang or "und" if lang != "" else "", tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    out = []
    for lang in total:
        found = []
        candidates = {p: a for (g, p), a in f.items() if g == lang and len(p) > 1 and a >= least}
        for p, a in candidates.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(len(q) > len(p) and 100 * b >= covered * a and inside(q) for q, b in candidates.items()):
                continue
            cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i, p.decode(), -a, le, r, total[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def phrase_rows(n):
    pick = random.Random(8)
    words = ["New", "york", "city", "the", "of", "Ünder", "a\x00b", "x" * 300]
    text = lambda: "".join(pick.choice(words) + pick.choice([" ", " ", " ", "\t", ", ", ".\n", " . "]) for _ in range(pick.randrange(40)))
    rows = [(text(), pick.choice(["en", "en", "en", "de", None, "und", ""])) for _ in range(n)]
    return rows + [(None, "en"), ("", None), ("?!", "en"), ("ha " * 5000, "de"), ("the new york times " * 700 + "no stop", "fr"), ("once only", "xx")] + [("copy of a copy", "en")] * 30


@pytest.mark.parametrize("longest, bound", [(2, 10**6), (3, 10**6), (3, 1), (4, 10**6)])
def test_collocations_equal_brute_force(spark, monkeypatch, longest, bound):
    monkeypatch.setattr(phrases, "BROADCAST_GROUPS", bound)
    monkeypatch.setattr(phrases, "BUCKET_ROWS", 3000)
    monkeypatch.setattr(phrases, "ROWS_AT_ONCE", 700)
    rows = phrase_rows(150)
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit("clash") for c in ("doc", "word", "code", "rank", "n", "key", "a")})
    found = phrases.collocations(docs.repartition(3), longest=longest).collect()
    assert sorted(tuple(r) for r in found) == collocations_by_hand(rows, longest)


def test_collocations_keep_the_best_and_take_empty_tables(spark):
    rows = phrase_rows(60)
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(tuple(r) for r in phrases.collocations(docs, top=7, least=3).collect()) == collocations_by_hand(rows, top=7, least=3)
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs.where("lang = 'xx'")).count() == 0


def test_words_that_share_a_key_change_the_seed(spark, monkeypatch):
    plain = phrases.word_keys
    monkeypatch.setattr(phrases, "word_keys", lambda lang, words, seed: plain(lang, words, seed) % (7 if seed == 0 else 1 << 62))
    docs = spark.createDataFrame([(" ".join(f"w{i} v{i}" for i in range(30)) + " ",)] * 10, "text string").withColumn("lang", F.lit("en"))
    assert phrases.keyed_counts(docs.withColumn("doc", F.monotonically_increasing_id()))[1] == 1


def test_scores_are_exact_beyond_64_bits(spark):
    a, le, r = 9_000_000_000_001, 9_000_000_000_123, 9_000_000_000_007
    level = spark.createDataFrame([(a, [le], [r])], "a long, lefts array<long>, rights array<long>")
    assert level.select(phrases.weakest_cut(2).alias("c")).first().c.score == 1000000 * a * a // (le * r)
