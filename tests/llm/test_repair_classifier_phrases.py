"""Conversation repair, the quality classifier and phrase mining against brute force, and on odd tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import conversation_repair, phrase_mining, quality_classifier

CONVS = "conv_id long, turn long, role string, text string"
AFTER = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
NAMES = {"u": "user", "a": "assistant"}


def shown(v):
    return " " if v is None else str(v)


def brute_damage(rows):
    """{conv_id: rows after damage, in order}; turns are distinct but for the damage's own repeats."""
    out = {}
    for conv, turn, role, text in rows:
        mine, k = out.setdefault(conv, []), zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        mine += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return {c: sorted(x, key=lambda y: (y[0] is not None, y[0] or 0)) for c, x in out.items()}


def brute_repair(rows):
    """The report of one conversation's rows, and its repaired rows."""
    seen, faults = set(), []
    for _, role, text in rows:
        left = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("b" if not left else "d" if (role, text) in seen else "t" if left[-1] not in ".!?" else "-")
        seen.add((role, text))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))

    def with_inserts(ways):
        for _ in range(3):
            for q, (cost, edits, out) in list(ways.items()):
                for letter, nxt in AFTER[q].items():
                    if letter != "s":
                        way = (cost + 3, edits + "I", (*out, (NAMES[letter], "")))
                        if nxt not in ways or way < ways[nxt]:
                            ways[nxt] = way
        return ways

    ways = with_inserts({0: (0, "", ())})
    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for q, (cost, edits, out) in ways.items():
            found = [(q, (cost + 4, edits + "D", out))]
            if fault not in "bd":
                extra = 3 * (fault == "t")
                found += [(AFTER[q][x], (cost + extra, edits + "K", (*out, (role, text)))) for x in [role[:1]] if x in AFTER[q]]
                found += [(AFTER[q][x], (cost + 3 + extra, edits + "R", (*out, (NAMES[x], text)))) for x in "ua" if x in AFTER[q]]
            for nxt, way in found:
                new[nxt] = min(way, new.get(nxt, way))
        ways = with_inserts(new)
    cost, edits, out = min(ways[q] for q in (0, 3) if q in ways)
    return (gaps, *(faults.count(x) for x in "bdt"), illegal, cost, edits), out


def digest(out):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def conversations(seed, n, most):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(n)]:
        turns = rng.sample(range(-5, 3 * most), rng.randint(1, most))
        for k, turn in enumerate(sorted(turns)):
            role = rng.choice(["user", "assistant", "assistant" if k % 2 else "user", "system", None, "", "User", "tool"] if k else ["system", "user", None])
            text = rng.choice(["Yes.", "no", "", None, " \t\n", "What?\n ", f"text {turn}.", f"text {turn}", "é!\x0b", "漢字。"])
            rows.append((conv, None if k == 0 and rng.random() < 0.2 else turn, role, text))
    return rows


@pytest.mark.parametrize("piece", [200, 3])
def test_conversation_repair(spark, piece):
    """Also with conversations in several pieces, whose repair must be the same."""
    rows = conversations(5, 60, 14)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, CONVS).selectExpr("*", "1 AS n", "2 AS row", "'x' AS piece", "3 AS whole", "'y' AS signature", "4 AS place")
    got = {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in conversation_repair.digested(conversation_repair.damaged(df), piece).collect()}
    want = {}
    for conv, mine in brute_damage(rows).items():
        report, out = brute_repair(mine)
        want[conv] = (*report, digest(out))
    assert got == want and len(got) == 61


@pytest.mark.parametrize("piece", [200, 4])
def test_repaired_rows(spark, piece):
    """The operator's own outputs, without damage: the report and the rows themselves, which then need no repair."""
    rows = [r for r in conversations(8, 40, 9) if r[1] is not None]
    report, repaired = conversation_repair.repair(spark.createDataFrame(rows, CONVS), piece)
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append((r[1], shown(r[2]), shown(r[3])))
    have = defaultdict(list)
    for r in repaired.orderBy("place").collect():
        have[r.conv_id].append((r.role, r.text))
    reports = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in report.collect()}
    for conv, mine in by.items():
        want, out = brute_repair(sorted(mine, key=lambda x: x[0]))
        assert reports[conv] == want and have.get(conv, []) == list(out)
        assert re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] for r, _ in have.get(conv, [])))


def test_least_edits_of_all():
    """The recursion against every sequence of edits with two inserts before a row at most."""

    def every(signature, state):
        for n in range(3):
            for q, k in conversation_repair.INSERTS[state]:
                if k == n:
                    if not signature:
                        if q in (0, 3):
                            yield 3 * n, "I" * n
                        continue
                    for edit, cost, nxt in conversation_repair.step(q, signature[0]):
                        for more, edits in every(signature[1:], nxt):
                            yield 3 * n + cost + more, "I" * n + edit + edits

    known: dict = {}
    for n in range(5):
        for letters in itertools.product("DsuaxUA", repeat=n):
            s = "".join(letters)
            if n < 4 or zlib.crc32(s.encode()) % 7 == 0:
                assert conversation_repair.finished(conversation_repair.solve(s, known)) == min(every(s, 0)), s


def test_conversations_of_ties_and_of_nothing(spark):
    """Rows of equal turns, repeated rows, null keys and very long texts; a conversation without rows; the same however it is cut."""
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 0, "assistant", "Yes!"), (1, 0, "assistant", "No"), (None, None, None, None), (None, None, "user", "b " * 100_000 + "."), (2, 2**62, "user", "a."), (2, -(2**62), "user", "b.")]
    rows += [(3, k % 5, "user" if k % 2 else "assistant", f"t{k % 17}.") for k in range(100)]
    df = spark.createDataFrame(rows, CONVS).withColumn("n", F.lit(1)).unionByName(spark.createDataFrame([(9, 0, "user", "gone")], CONVS).withColumn("n", F.lit(0)))
    cut, whole = ({r.conv_id: tuple(r) for r in conversation_repair.digested(df, piece).collect()} for piece in (7, 200))
    assert cut == whole and set(cut) == {1, 2, 3, 9, None}
    assert cut[9] == (9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert cut[1][3] == 1 and cut[3][3] >= 100 - 34 and cut[2][1] is None or cut[2][1] == 2**63 - 1
    assert conversation_repair.digested(df.limit(0)).count() == 0


def test_quality_classifier_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_classifier.query(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    told = [(r.predicted, quality[r.doc_id]) for r in rows if r.held_out and r.doc_id in quality]
    assert len(told) > 80 and sum(a == b for a, b in told) / len(told) > 0.97
    for kind in (0, 1):
        mine = [a == kind for a, b in told if b == kind]
        assert sum(mine) / len(mine) > 0.9


def test_held_out_labels_are_never_read(spark):
    """Turning round every held-out label changes no score."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality_classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({r.doc_id: r.score for r in quality_classifier.quality_classifier(docs, x).collect()} for x in (labels, turned))
    assert one == two


def test_flattened_trees_score_as_the_model(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)).round(2)
    y = ((x[:, 0] > 0) ^ (x[:, 1] + x[:, 2] > 0.5)).astype(float)
    df = spark.createDataFrame([(float(b), a.tolist()) for a, b in zip(x, y)], "label double, x array<double>").select("label", "x", array_to_vector("x").alias("features"))
    model = GBTClassifier(maxIter=7, maxDepth=3, seed=1).fit(df)
    want = [r.p for r in model.transform(df).select(vector_to_array("probability")[1].alias("p")).collect()]
    assert np.allclose(quality_classifier.Trees.of_model(model).scores(x), want)


def test_statistics():
    texts = ["", " \n\t", "a", "The CAT sat. The cat sat!\nThe cat sat?\n\n12 é#", "x x x y\nx x x y", "é" * 50, "w " * 3000]
    got = quality_classifier.statistics([t.encode() for t in texts])
    for t, row in zip(texts, got):
        b, words = t.encode(), [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
        x = dict(zip(quality_classifier.FEATURES, row))
        n = max(1, len(words))
        windows = Counter(zip(words, words[1:], words[2:]))
        assert np.isclose(x["words"], np.log1p(len(words))) and np.isclose(x["chars"], np.log1p(len(b)))
        assert np.isclose(x["upper"] * max(1, len(b)), sum("A" <= c <= "Z" for c in t)) and np.isclose(x["distinct"], len(set(words)) / n)
        assert np.isclose(x["top_word"], max(Counter(words).values(), default=0) / n)
        assert np.isclose(x["again"], sum(a == c for a, c in itertools.pairwise(words)) / n)
        assert np.isclose(x["windows"], sum(v for v in windows.values() if v > 1) / max(1, len(words) - 2))
        lines = [y for y in t.split("\n") if y]
        assert np.isclose(x["distinct_lines"], len(set(lines)) / max(1, len(lines)))
    together = quality_classifier.statistics([b"one two", b"one two"])
    assert (together[0] == together[1]).all()


def test_classifier_of_odd_rows(spark, odd, none):
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    score = lambda docs, labels: {(r.doc_id, r.score) for r in quality_classifier.quality_classifier(docs, labels).collect()}
    kinds = [k for k in range(60) if zlib.crc32(str(k).encode()) % 3 != 1]
    assert quality_classifier.quality_classifier(none, label([(kinds[0], 1)])).count() == 0
    assert {s for _, s in score(odd, label([]))} == {0.5} == {s for _, s in score(odd, label([(2, None), (None, 1), (10**9, 0)]))}
    rows = [(k, ("good text here. " if k % 2 else "## %% && ") * 20) for k in kinds] + [(kinds[0], "again"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS label", "2 AS x", "3 AS score", "4 AS quality")
    assert {s for _, s in score(docs, label([(k, 0) for k in kinds]))} == {0.0}
    assert {s for _, s in score(docs, label([(kinds[0], 1), (kinds[0], 0), (kinds[1], 1)]))} == {1.0}
    found = quality_classifier.quality_classifier(docs, label([(k, k % 2) for k in kinds])).collect()
    assert len(found) == len(rows) and all(r.predicted == r.doc_id % 2 for r in found if r.doc_id in kinds[1:])
    assert len({r.score for r in found if r.doc_id is None}) == 1


def brute_phrases(rows, top, min_count, most_words=4, covered=80):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most_words + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        inner = lambda p: {p[i : i + k] for k in range(2, len(p)) for i in range(len(p) - k + 1)}
        gone = {q for p, a in found.items() for q in inner(p) if 100 * a >= covered * found[q]}
        rows = []
        for p in found.keys() - gone:
            score, _, left, right = min((2_000_000 * f[p] // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -f[p], " ".join(p).encode(), left, right))
        out |= {(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)}
    return out


def phrase_rows(seed, n):
    rng = random.Random(seed)
    words, ends = ["a", "b", "B", "cé", "dd", "e-e", "漢字", "x1", "(y)"], [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "; ", "! "]
    rows = [(rng.choice(["en", "en", "en", None, "und", "", "de"]), "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 60)))) for _ in range(n)]
    return [*rows, ("en", None), (None, ""), ("de", " \t."), ("de", "a " * 500), ("en", "the quick brown fox. " * 40), *rows[:5]]


@pytest.mark.parametrize("buckets,min_count,top", [(1 << 16, 5, 20), (64, 5, 2000), (256, 300, 10)])
def test_phrase_mining(spark, buckets, min_count, top):
    """Few buckets let more through to the exact counts and change nothing."""
    rows = phrase_rows(3, 150)
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS f", "'x' AS phrase", "2 AS block", "3 AS n", "4 AS k", "5 AS `rank`").repartition(5)
    got = phrase_mining.collocations(df, top=top, min_count=min_count, buckets=buckets)
    assert {tuple(r) for r in got.collect()} == brute_phrases(rows, top, min_count) != set()


def test_phrases_of_nothing(spark, none):
    assert phrase_mining.collocations(none, buckets=64).count() == 0
    few = spark.createDataFrame([("en", "a b c")], "lang string, text string")
    assert phrase_mining.collocations(few, buckets=64).count() == 0


def test_long_texts_are_cut_between_pieces():
    text = b"one two, three four five. " * 50 + b"x" * 200 + b" tail"
    found = list(phrase_mining.parts(text, 64))
    assert b"".join(found) == text and len(found) > 10
    assert all(phrase_mining.KIND[p[0]] == 2 for p in found[1:]) and all(len(p) < 64 + 30 for p in found[:-1])
    assert list(phrase_mining.parts(b"no end at all here", 4)) == [b"no end at all here"]


def test_scores_beyond_64_bits(spark):
    """A count whose product with two million passes 64 bits."""
    big = 6 * 10**12
    tables = [spark.createDataFrame(rows, "lang string, phrase string, f long") for rows in ([("en", "a", big + 7), ("en", "b", big)], [("en", "a b", big - 1)])]
    row = phrase_mining.scored(tables).collect()[0]
    assert (row.l, row.r, row.score) == (big + 7, big, 2_000_000 * (big - 1) // (2 * big + 7))
