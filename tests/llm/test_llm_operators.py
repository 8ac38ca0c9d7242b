"""The corpus operators against brute force, and on odd tables."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import pytest

from sparkloom.llm import bpe, fingerprints, jaccard_join, license_scan, line_dedup, mixing, quality_rules, suffix_dedup, url_filter, warc_zip
from sparkloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ON_DOCUMENTS = {
    "suffix": suffix_dedup.suffix_dedup, "fingerprints": fingerprints.fingerprints, "jaccard": jaccard_join.jaccard_join, "license": license_scan.license_scan, "lines": line_dedup.line_dedup,
    "bpe": lambda d: bpe.encode(d, decoded=True), "quality": quality_rules.quality_rules, "mixing": mixing.mix,
}


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_empty_table(none, name):
    assert ON_DOCUMENTS[name](none).count() == 0


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_odd_rows(odd, name):
    rows = ON_DOCUMENTS[name](odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter({None: 1, 2: 2, 4: 1})
    twins = [tuple(map(str, r)) for r in rows if r.doc_id == 2]
    if name == "mixing":  # equal rows are judged each, as a target may lie between them
        assert abs(int(twins[0][5]) - int(twins[1][5])) <= 1
    elif name != "fingerprints":  # a row's neighbour is its twin or the next document
        assert twins[0] == twins[1]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.mark.parametrize("held_runs", [20_000, 2])
def test_suffix_dedup(docs, corpus, held_runs):
    got, seen = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs, held_runs=held_runs).collect()}, set()
    for doc, text, *_ in corpus:
        b = (text or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = [True] * 100
            seen.add(b[i : i + 100])
        r = got[doc]
        assert bytes(r.kept) == bytes(c for c, g in zip(b, gone) if not g)
        assert (r.n_bytes, r.n_removed) == (len(b), sum(gone))
        assert r.n_spans == sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)) == len(r.spans)


def test_suffix_dedup_over_many_ranges(spark, docs, corpus):
    """Groups that lie across the edges of ranges."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        test_suffix_dedup(docs, corpus, 20_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("held_runs", [20_000, 2])
def test_suffix_dedup_of_equal_ids_with_different_texts(spark, held_runs):
    """Null and repeated ids: each text keeps its own spans, also where the other's lie beyond its end; equal rows count as one."""

    def letters(k, n):
        return "".join(chr(97 + x % 26) for h in range(n // 32 + 1) for x in hashlib.sha256(f"{k}/{h}".encode()).digest())[:n]

    rows, want = [], {}
    for base, doc in ((0, None), (50, 7)):
        passage, own = letters(base, 150), letters(base + 1, 400)
        twice, short, shares = own + passage + own[:3] + passage, letters(base + 2, 120), letters(base + 3, 90) + passage
        rows += [(doc, twice), (doc, short), (doc, shares), (doc, short)]
        want[doc] = (short, {(own + passage + own[:3], letters(base + 3, 90) + passage), (own + passage + own[:3], letters(base + 3, 90)), (own + own[:3], letters(base + 3, 90) + passage)}, twice, shares)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(list)
    for r in suffix_dedup.suffix_dedup(df, held_runs=held_runs).collect():
        got[r.doc_id].append((r.n_bytes, bytes(r.kept).decode(), r.n_removed))
    for doc, (short, pairs, twice, shares) in want.items():
        by = {n: kept for n, kept, _ in got[doc]}
        assert len(got[doc]) == 4 and [x for x in got[doc] if x[0] == 120] == [(120, short, 0)] * 2
        assert (by[len(twice)], by[len(shares)]) in pairs and sum(gone for _, _, gone in got[doc]) == 300


@pytest.mark.parametrize("held_runs", [20_000, 2])
def test_suffix_dedup_of_repeated_rows(spark, docs, corpus, held_runs):
    """Each row twice: the same result as for one of each, twice."""
    once = suffix_dedup.suffix_dedup(docs, held_runs=held_runs).collect()
    twice = suffix_dedup.suffix_dedup(docs.unionByName(docs), held_runs=held_runs).collect()
    assert Counter(map(str, twice)) == Counter({k: 2 * n for k, n in Counter(map(str, once)).items()})
    a, b, shared = (hashlib.sha256(x).hexdigest() * k for x, k in ((b"a", 3), (b"b", 3), (b"c", 2)))
    df = spark.createDataFrame([(1, a + shared), (1, a + shared), (2, b + shared)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in suffix_dedup.suffix_dedup(df, held_runs=held_runs).collect())
    alone = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(df.distinct(), held_runs=held_runs).collect()}
    assert got == [(1, alone[1]), (1, alone[1]), (2, alone[2])] and alone[2] >= 128


def brute_like(a, b):
    """Common characters at both ends, and the share of common spans."""
    if a == b:
        return 1.0
    front = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    back = next((k for k, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    return min(front + back, len(a), len(b)) / max(1, len(a), len(b))


def test_fingerprints(docs, corpus):
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    prints = defaultdict(set)
    for k, (doc, text, *_) in enumerate(corpus):
        text, after = text or "", corpus[(k + 1) % len(corpus)][1] or ""
        q = len(text) // 4
        new = text[: len(text) - q] + after[:q] if q else text
        r = got[doc]
        assert (r.n_chars, r.edited) == (len(text), new)
        prints[text].add(r.fingerprint)
        prints[new].add(r.edited_fingerprint)
        for near, other in ((r.near_edited, new), (r.near_next, after)):
            ends = brute_like(text, other)
            a, b = ({t[i : i + 24] for i in range(len(t) - 23)} for t in (text, other))
            assert near == 1 if text == other else ends - 1e-6 <= near < 1
            assert abs(near - ends) < 1e-6 or abs(near - len(a & b) / max(1, len(a | b))) < 0.35
    assert all(len(p) == 1 for p in prints.values()) and len({p for x in prints.values() for p in x}) == len(prints)
    a, b, c = (fingerprints.Print(t) for t in ("xxhello world", "hello wonder", "say hello world"))
    assert fingerprints.longest_common_extension(a.h, b.h, 2, 0) == 8
    assert fingerprints.longest_common_extension(a.h, c.h, a.n, c.n, back=True) == 11
    assert fingerprints.likeness(got[3].fingerprint, got[15].fingerprint) > 0.8 > 0.2 > fingerprints.likeness(got[3].fingerprint, got[9].fingerprint)
    assert all(abs(fingerprints.likeness(r.fingerprint, r.edited_fingerprint) - r.near_edited) < 0.1 for r in got.values())


def test_fingerprints_over_many_ranges(spark):
    """Ranges cut within a doc_id that has many rows; the neighbours are those of the whole order."""
    rows = [(None if k % 3 == 0 else 5 if k % 3 == 1 else k, f"text {k * k} " * (k % 7 + 1)) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keys = fingerprints.with_next(df, lambda it: it, "doc_id long, text string, range int, halo int", per_range=10).collect()
    ranges = defaultdict(list)
    for r in keys:
        ranges[r.range].append(r)
    assert len(ranges) > 8 and sum(r.halo == 0 for r in keys) == 120 and max(map(len, ranges.values())) < 40
    order = [(r.doc_id, r.text) for k in sorted(ranges) for r in ranges[k] if not r.halo]
    assert [d for d, _ in order] == sorted([d for d, _ in rows], key=lambda d: -1 if d is None else d)
    ends = [[(r.doc_id, r.text) for r in ranges[k]][-1] for k in sorted(ranges)]
    begins = [(ranges[k][0].doc_id, ranges[k][0].text) for k in sorted(ranges)]
    assert ends == begins[1:] + begins[:1]


def sets(corpus, n):
    out = {}
    for doc, text, *_ in corpus:
        w = WORD.findall(lower(text or ""))
        out[doc] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


def brute_components(s, percent):
    label = {d: d for d in s}
    changed = True
    while changed:
        changed = False
        for a in s:
            for b in s:
                if s[a] and s[b] and label[b] < label[a] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                    label[a], changed = label[b], True
    return label


def test_jaccard_join_against_brute_force_in_all_regions(spark):
    """Small bounds, so that shingles come last, windows are lengthened and regions split: the same components."""
    import random

    rng = random.Random(9)
    base = [[f"b{k}w{j}" for j in range(60)] for k in range(4)]
    rows = []
    for doc in range(160):
        words = list(base[doc % 4] if doc % 7 else base[0][:30] + base[1][30:])
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = f"own{doc}" if rng.random() < 0.5 else f"some{rng.randrange(5)}"
        rows.append((doc, " ".join(words[rng.randrange(3) : len(words) - rng.randrange(3)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, percent, most in ((3, 90, 3), (2, 80, 2), (5, 80, 1)):
        signed, classes = jaccard_join.joined(df, n, percent, most)
        first = {(r.k1, r.k2): r.label for r in classes.collect()}
        label = {r.doc_id: first[r.k1, r.k2] for r in signed.collect()}
        groups, want = defaultdict(set), defaultdict(set)
        for doc, c in brute_components(sets(rows, n), percent).items():
            want[c].add(doc)
        for doc, c in label.items():
            groups[c].add(doc)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (2, 50)])
def test_jaccard_join(docs, corpus, n, percent):
    s = sets(corpus, n)
    want = brute_components(s, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(docs, n, percent).collect()}
    assert got == {d: (len(s[d]), want[d]) for d in s}


def test_jaccard_join_of_a_chain(spark):
    """Neighbours link, ends don't: found by the pivots' recursion and what is left after it."""
    words = [f"v{k}" for k in range(240)]
    rows = [(k, " ".join(words[2 * k : 2 * k + 100])) for k in range(50)]
    rows += [(100 + k, " ".join(["hot"] * 1 + words[200:] + [f"t{k}_{j}" for j in range(30)])) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    s = sets(rows, 3)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(df).collect()}
    assert got == brute_components(s, 90) and got[49] == 0


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 30)] + [(50, 51), (51, 50), (60, 60), (None, 3)], "a long, b long")
    got = {r.id: r.label for r in components(edges).collect()}
    assert got == {**{k: 1 for k in range(1, 31)}, 50: 50, 51: 50}


def test_license_scan(docs, corpus):
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    for doc, text, *_ in corpus:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
        places, labels = [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        r = got[doc]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), sorted(labels))
    assert [(s.label, s.line) for s in got[24].spans] == [("mit", 0), ("mit", 1), ("mit", 2)]


def test_license_scan_finds_every_matching_block():
    """Prefix, length and positional filters lose no block that plain containment finds."""
    import random

    rng = random.Random(5)
    templates = license_scan.Templates(license_scan.TEMPLATES, {b"license": 9, b"the": 99, b"under": 5}, 0.7)
    vocabulary = sorted({w for _, t, _ in templates.all for w in t} | {b"q%d" % k for k in range(9)})
    for _ in range(3000):
        block = set(rng.sample(vocabulary, rng.randint(0, len(vocabulary))))
        want = [(label, len(block & set(t)) / len(t)) for label, t, need in templates.all if len(block & set(t)) >= need]
        assert templates.matches(block) == want


def test_license_scan_labels_against_brute_force(spark):
    """Templates from a table, of several lines: a label and its score are those of the fullest run of words of the template's width."""
    import math
    import random

    rng = random.Random(11)
    templates = {"a": "one two three four five\nsix seven eight nine ten", "b": "one one two\nthree", "c": "lone", "none": " .. "}
    table = spark.createDataFrame([*templates.items(), ("d", None)], "label string, text string")
    vocabulary = "one two three four five six seven eight nine ten lone x y z".split()
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(150)]
    texts += [" ".join(rng.sample(vocabulary[:10], 10)) + "\n" + " ".join(["x"] * 9) for _ in range(9)] + [None, ""]
    rows = license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates=table).collect()
    for r in rows:
        words, want = (texts[r.doc_id] or "").split(), {}
        for label, text in templates.items():
            tokens, width = set(re.findall("[a-z]+", text)), math.ceil(len(re.findall("[a-z]+", text)) / 0.9 - 1e-9)
            most = max((len(tokens & set(words[k : k + width])) for k in range(len(words))), default=0)
            if tokens and most >= math.ceil(0.9 * len(tokens) - 1e-9):
                want[label] = most / len(tokens)
        assert {label: max(s.containment for s in r.spans if s.label == label) for label in {s.label for s in r.spans}} == want
    with pytest.raises(ValueError):
        license_scan.templates_of(spark.range(license_scan.MOST_TEMPLATES + 1).selectExpr("cast(id AS string) AS label", "'x' AS text"))


def test_license_scan_of_a_long_text():
    """Many places in a long text are counted in proportion to its length."""
    import time

    text = ("all rights reserved " * 200_000).encode()
    began = time.time()
    got = license_scan.scan_text(text, [(re.compile(rb" all rights reserved(?= )"), "reserved")], license_scan.Templates(license_scan.TEMPLATES, {}, 0.9))
    assert got[:5] == (600_000, 200_000, 0, 599_997, ["reserved"]) and time.time() - began < 20


def test_license_scan_across_lines(spark):
    """Wrapped notices are found at their first line; words strewn over a long text aren't a notice, and those behind others still are."""
    mit = license_scan.TEMPLATES["mit-notice"].split()
    wrapped = "Copyright (c) someone\n\n" + "\n".join(" * " + " ".join(mit[k : k + 9]) for k in range(0, len(mit), 9))
    bsd = license_scan.TEMPLATES["bsd"].split()
    strewn = "released " + "x " * 50 + "under the " + "y " * 50 + "mit " + "z " * 50 + "license" + " v" * 9
    texts = [wrapped, "a\n" + " ".join(bsd[:12]) + "\n" + " ".join(bsd[12:]), strewn, strewn + "\nReleased under\nthe MIT License"]
    rows = license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: sorted((s.label, s.line, s.containment) for s in r.spans) for r in rows}
    assert got == {0: [("mit-notice", 2, 1.0), ("mit-text", 2, 1.0)], 1: [("bsd", 1, 1.0)], 2: [], 3: [("mit", 1, 1.0)]}


def test_license_blocks_against_brute_force():
    """A text has a block exactly if some run of words of the width holds enough of the tokens."""
    import random

    rng = random.Random(3)
    for _ in range(3000):
        tokens = [b"t%d" % k for k in range(rng.randint(1, 6))]
        need, width = rng.randint(1, len(tokens)), rng.randint(len(tokens), 9)
        words = [rng.choice([*tokens, b"x", b"y"]) for _ in range(rng.randint(0, 40))]
        most = [len(set(words[k : k + width]) & set(tokens)) for k in range(len(words))]
        got = license_scan.blocks(words, tokens, need, width)
        assert bool(got) == (max(most, default=0) >= need)
        assert not got or max(c for _, c in got) == max(most) / len(tokens)
        assert all(most[at] >= round(c * len(tokens)) >= need for at, c in got)


def test_line_dedup(spark):
    fixed = "terms of service apply to all visitors"
    logs = [(k, f"session {k} opened for user number {k * 7} at host {k}\nunique text {'abcdefghijklmnopqrstuvwxyz'[k % 26]} {k} only\n{fixed}") for k in range(12)]
    named = [(100 + k, f"dear valued customer {n} we thank you for your order today") for k, n in enumerate("ann bob cid dan eve fay gus hal ian joe kim lee".split())]
    few = [(200 + k, "a line that three documents share") for k in range(3)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(logs + named + few, "doc_id long, text string")).collect()}
    assert got[0].dropped == [] and all(sorted(got[k].dropped)[:1] == [0] and 2 in got[k].dropped for k in range(1, 12))
    assert got[100].kept_text == named[0][1] and all(got[100 + k].kept_text == "" for k in range(1, 12))
    assert all(got[200 + k].kept_text == few[k][1] for k in range(3))


def test_line_dedup_finds_every_group_of_a_leaf(spark):
    """Two templates with words as fields and a fixed line that is more frequent, in one leaf; documents of several forms count once."""
    names = ["".join(p) for p in zip("abcdefghijklmnopqrst", "qwertyuiopasdfghjklz", "zxcvbnmlkjhgfdsapoiu")]
    thanks = [(k, f"dear valued customer {n} we thank you for ordering today") for k, n in enumerate(names)]
    parcel = [(100 + k, f"dear valued customer {n} your parcel has arrived at home") for k, n in enumerate(names)]
    fixed = [(200 + k, "dear valued customer please read all these new terms now") for k in range(30)]
    one = [(300 + k // 4, f"dear valued customer {n} in this shop nothing is free") for k, n in enumerate(names)]
    rows = defaultdict(list)
    for doc, line in thanks + parcel + fixed + one:
        rows[doc].append(line)
    df = spark.createDataFrame([(d, "\n".join(x)) for d, x in rows.items()], "doc_id long, text string")
    got = {r.doc_id: r.dropped for r in line_dedup.line_dedup(df).collect()}
    for start, size in ((0, 20), (100, 20), (200, 30)):
        assert got[start] == [] and all(got[start + k] == [0] for k in range(1, size))
    assert all(got[300 + k] == [] for k in range(5))
    tokens = [(1, k, 1 + k % 3, 0, line.split()) for k, (_, line) in enumerate(thanks + parcel + one)]
    forms = spark.createDataFrame(tokens, "leaf long, template long, n_docs long, first_doc long, t array<string>")
    by = [{r.template: r.rep for r in line_dedup.grouped(forms, reps=n).collect()} for n in (1, 2, 32)]
    assert by[0] == by[1] == by[2] and len(set(by[0].values())) == 3


def test_line_dedup_of_long_lines(spark):
    """Long lines recur from two documents on, if they are the same; short ones don't, nor do long ones that differ in a number."""
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(51)]
    long, short, numbered = " ".join(words), " ".join(words[:50]), [" ".join([*words, "left", str(k)]) for k in range(2)]
    texts = [f"{long}\n{short}\n{numbered[0]}", f"own text\n {long.replace(' ', '  ')} \n{short}\n{numbered[1]}", f"{long}\n{long}"]
    got = {r.doc_id: sorted(r.dropped) for r in line_dedup.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: [], 1: [1], 2: [0, 1]}


def test_line_dedup_against_brute_force(docs, corpus):
    """Exact templates only: what recurs is counted by hand."""
    count = defaultdict(set)

    def form(line):
        return re.sub(r"[^ ]*[0-9][^ ]*", "<*>", " ".join(WORD.findall(line.lower())))

    for doc, text, *_ in corpus:
        for line in (text or "").split("\n"):
            if WORD.search(line):
                count[form(line)].add(doc)
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs, min_docs=2, alike=101).collect()}
    for doc, text, *_ in corpus:
        want = {k for k, x in enumerate((text or "").split("\n")) if WORD.search(x) and len(count[form(x)]) > 1 and min(count[form(x)]) != doc}
        assert set(got[doc].dropped) == want


def test_bpe(docs, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    got = {r.doc_id: r for r in bpe.encode(docs, decoded=True).collect()}
    for doc, text, *_ in corpus:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[doc].ids == ids and got[doc].decoded == t.decode(ids, skip_special_tokens=False)
    again = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    assert again == {doc: text or "" for doc, text, *_ in corpus}


def test_bpe_of_uneven_spaces():
    """Runs of texts, some with runs of spaces, other white space and special tokens: as the tokenizers library has it."""
    import random

    from tokenizers import Tokenizer

    t, encoder = Tokenizer.from_file(bpe.default_path()), bpe.Encoder(bpe.Vocabulary(bpe.default_path()), None)
    rng = random.Random(6)
    parts = ["the", "word", "s", "'ll", ".", ",", "12", "é漢", " ", "  ", "\n", " \n", "\t", "\u00a0", "\u3000", "<|endoftext|>", "x" * 60]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["", " ", "a", " a", "a "]
    flat, ends = encoder.encode_all(texts)
    for k, text in enumerate(texts):
        assert flat[ends[k] : ends[k + 1]].tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_lexicon(tmp_path):
    words = {w.encode(): tuple(range(k % 4 + 1)) for k, w in enumerate(["car", "cars", "cat", "cats", "star", "stars", "é", "éa", "a"])}
    path = tmp_path / "lexicon"
    path.write_bytes(bpe.compile_lexicon(words))
    lexicon = bpe.Lexicon(str(path))
    assert all(lexicon.get(w) == ids for w, ids in words.items())
    assert all(lexicon.get(w) is None for w in (b"", b"ca", b"carss", b"z", "é".encode()[:1]))
    suffixes = {w.encode() + b"ing": (1,) for w in "abcdefgh"}
    assert len(bpe.compile_lexicon(suffixes)) < len(bpe.compile_lexicon({w[::-1]: (1,) for w in suffixes})) + 400  # shared endings


def test_long_words_merge_alike():
    vocabulary = bpe.Vocabulary(bpe.default_path())
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    for w in ("a" * 3000, "abc" * 700, "x" * 47 + "the" * 60):
        assert list(vocabulary.merge(w.encode())) == t.encode(w, add_special_tokens=False).ids


def test_quality_rules(docs, corpus):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, max_docs=2).collect()}
    by_host = defaultdict(set)
    for doc, text, _, source, _ in corpus:
        for line in (text or "").split("\n"):
            if WORD.search(line):
                by_host[source or "", " ".join(WORD.findall(line.lower()))].add(doc)
    for doc, text, _, source, _ in corpus:
        text = text or ""
        w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
        shared = [by_host[source or "", " ".join(WORD.findall(x.lower()))] for x in lines]
        recurring = sum(len(WORD.findall(x)) for x, s in zip(lines, shared) if len(s) > 2 and min(s) != doc)
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        depleted = recurring > 0 and (len(w) - recurring < 50 or 100 * (len(w) - recurring) < 30 * len(w))
        r = got[doc]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text))
        assert (r.n_dup_lines, r.n_repeat_words, r.n_recurring) == (len(lines) - len(set(lines)), len(inside), recurring)
        assert (r.base_failed, r.kept) == (failed, not failed and not depleted)


def test_mixing(docs, corpus):
    rows = mixing.mix(docs, docs_per_block=2, shards=4).collect()
    again = mixing.mix(docs.repartition(7), docs_per_block=2, shards=4).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    size = {doc: len(WORD.findall(text or "")) for doc, text, *_ in corpus}
    total = Counter()
    for doc, _, _, source, _ in corpus:
        total[source] += size[doc]
    sources = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sources)}
    target, free, left = {}, set(sources), sum(total.values())
    while True:  # rounds of resharing
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if share * weight[s] >= 3 * total[s]}
        if not full:
            break
        target |= {s: 3 * total[s] for s in full}
        left, free = left - sum(3 * total[s] for s in full), free - full
    target |= {s: share * weight[s] for s in free}
    largest = max(size.values())
    taken = Counter()
    for r in rows:
        assert (r.size, r.source_size) == (size[r.doc_id], total[r.source]) and r.target == pytest.approx(target[r.source])
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(size[d] for d, _, _, src, _ in corpus if src == s) <= largest for s in sources)
    mixed = mixing.mixed(docs, docs_per_block=2, shards=4)
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in rows if r.copies})


def test_splitting_tree_is_exact():
    counts = {1: 17, 2: 5, 3: 0, 4: 40}
    tree = mixing.split(counts, 7)
    assert {k: sum(t[k] for t in tree.values()) for k in counts} == counts
    for shards in range(1, 40):
        sums = [sum(t.values()) for t in mixing.split(counts, shards).values()]
        assert len(sums) == shards and max(sums) - min(sums) <= 1


def test_shards_hold_the_drawn_blocks(spark):
    """Of every source that much goes to the shards as is taken, whole blocks of a pass to one shard, and shards differ by one block."""
    rows = [(k, "one two three four", f"s{k % 3}") for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, docs_per_block=10, shards=8).collect()
    assert all(len(r.shards) == r.copies for r in got)
    words, total = Counter(), Counter()
    for r in got:
        for shard in r.shards:
            words[shard, r.source] += r.size
        total[r.source] += r.taken
    assert all(sum(words[k, s] for k in range(8)) == n and abs(n - target) <= 4 for s, n, target in ((r.source, total[r.source], r.target) for r in got))
    per_shard = [sum(words[k, s] for s in total) for k in range(8)]
    # blocks hold about 10 documents of 4 words each
    assert max(per_shard) - min(per_shard) <= 0.35 * max(per_shard)
    drawn = spark.createDataFrame([(s, b, k) for s, n in ((1, 90), (2, 7), (3, 30)) for b in range(n) for k in range(1, 3)], "source_key long, block long, pass int")
    dealt = mixing.shards_of(drawn, shards=8).collect()
    per_shard = Counter(r.shard for r in dealt)
    assert len({(r.source_key, r.block, r["pass"]) for r in dealt}) == len(dealt) == 254 and set(per_shard.values()) == {31, 32}
    moved = Counter(r.source for r in mixing.mixed(df, docs_per_block=10, shards=8).collect())
    assert all(moved[s] * 4 == total[s] for s in total)


PAGES = "page_id long, url string, html string"


def test_url_filter(spark, sf):
    rows = [(1, "http://a.example.net/en/x?q=1", ""), (2, "https://B.NET/", ""), (3, "http://net", ""), (4, "http://x.org/fr/#t", ""), (5, "example.com/de/", ""), (6, None, ""), (7, "http://example.com/de/9", ""), (8, "http://notexample.com/de/9", "")]
    got = {r.page_id: r for r in url_filter.url_filter(spark.createDataFrame(rows, PAGES)).collect()}
    assert {k: r.rule for k, r in got.items()} == {1: "example.net/en/", 2: "net/", 3: None, 4: "org/fr/", 5: None, 6: None, 7: "example.com/de/", 8: None}
    assert [got[k].verdict for k in (1, 2, 4, 7)] == ["allow", "block", "allow", "block"]
    assert (got[2].host, got[2].path, got[6].host, got[5].path) == ("b.net", "/", "", "")
    assert url_filter.url_filter(spark.createDataFrame([], PAGES)).count() == 0
    assert {r.verdict for r in url_filter.url_filter(spark.createDataFrame(rows[2:3], PAGES)).collect()} == {"allow"}


def test_url_filter_held_out(spark):
    """Trees fitted on the ruled URLs of some hosts name those of hosts that they haven't seen."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    ruled = url_filter.split_url(pages).withColumn("rule", url_filter.rule_of())
    ruled = ruled.withColumn("ruled", url_filter.verdict_of()).filter("ruled IS NOT NULL").withColumn("label", (F.col("ruled") == "block").cast("double"))
    held = F.pmod(F.xxhash64("host"), F.lit(4)) == 0
    trees = url_filter.Trees(ruled.filter(~held))
    got = trees.scored(ruled.filter(held)).select("label", "score", "host").collect()
    right = sum((r.score > 0.5) == (r.label == 1.0) for r in got)
    commonest = max(Counter(r.label for r in got).values())
    print("held-out accuracy", right / len(got), "commonest label", commonest / len(got), "hosts", len({r.host for r in got}))
    assert len(got) > 100 and right >= max(0.9 * len(got), commonest)


def test_url_filter_odd_rows(spark):
    rows = [(None, None, None), (1, "http://b.net/" + "x" * 100_000, ""), (1, "http://b.net/" + "x" * 100_000, ""), (2, "http://x.org/fr/", ""), (3, "://", "")]
    clash = "'a' AS host, 1 AS path, 2 AS rule, 'b' AS score, 3 AS label, 4 AS fold, 5 AS suffix, 6 AS features"
    got = url_filter.url_filter(spark.createDataFrame(rows, PAGES).selectExpr("*", *clash.split(", "))).collect()
    assert Counter((r.page_id, r.rule) for r in got) == Counter({(None, None): 1, (1, "net/"): 2, (2, "org/fr/"): 1, (3, None): 1})


def test_warc(spark):
    html = ["<p>x</p>", "é" * 5000, "<p>x</p>", "", None, "<p>x</p>", "y"]
    pages = spark.createDataFrame([(k, None if k == 3 else f"http://h/{k}\n", h) for k, h in enumerate(html)], PAGES)
    manifest = warc_zip.write_packages(pages, package_bytes=2000)
    assert sum(r.records for r in manifest.collect()) == len(html)
    first = {}
    for r in warc_zip.read_packages(manifest).orderBy("page_id").collect():
        b = (html[r.page_id] or "").encode()
        origin = first.setdefault(b, r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if origin == r.page_id else ("revisit", origin))
        assert bytes(r.payload) == (b if origin == r.page_id else b"")
    assert warc_zip.read_packages(warc_zip.write_packages(spark.createDataFrame([], PAGES))).count() == 0


def test_warc_is_read_in_parts(spark, monkeypatch):
    """Each record falls to one part of its package's index, also where a part has none; odd rows and clashing columns do no harm."""
    import random

    rng = random.Random(4)
    pages = [(k, f"http://h/{k}", "".join(rng.choices("abcdefghij", k=k * 13 % 700))) for k in range(150)] + [(None, None, "x"), (5, "http://h/5", "twice"), (5, "http://h/5", "twice")]
    df = spark.createDataFrame(pages, PAGES).selectExpr("*", "1 AS sha", "'a' AS first", "2 AS n", "3 AS package", "4 AS part", "5 AS bytes")
    monkeypatch.setattr(warc_zip, "PART_BYTES", 3000)
    manifest = warc_zip.write_packages(df.coalesce(1), package_bytes=20_000)
    read = warc_zip.read_packages(manifest)
    assert read.rdd.getNumPartitions() >= sum(r.bytes // 3000 for r in manifest.collect()) > 5
    assert Counter(r.page_id for r in read.collect()) == Counter(p for p, *_ in pages)


def test_zip_directories(tmp_path):
    """Packages that other writers made, with and without ZIP64 fields and a comment."""
    import zipfile

    from pyarrow import fs

    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.comment = b"PK comment" * 50
        z.writestr("a", b"123")
        with z.open(zipfile.ZipInfo("b"), "w", force_zip64=True) as f:
            f.write(b"4567")
        z.writestr(zipfile.ZipInfo("c"), b"9" * 100, zipfile.ZIP_DEFLATED)
    with fs.LocalFileSystem().open_input_file(str(path)) as f:
        found = warc_zip.directory(f)
        assert {n: f.read_at(size, warc_zip.data_place(f, at)) for n, (at, size) in found.items()} == {"a": b"123", "b": b"4567"}
    (tmp_path / "b.zip").write_bytes(b"nothing")
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "b.zip")) as f, pytest.raises(ValueError):
        warc_zip.directory(f)


def test_quality_rules_filtered_on_a_long_text(spark):
    """A filter on the verdict, which the planner pushes into the counts, takes time in proportion to the text."""
    import time

    texts = [" ".join(f"w{j * j % 7919}" for j in range(20_000)), " ".join(f"v{j}" for j in range(20_000)), "short"]
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    began = time.time()
    assert sorted(r.doc_id for r in quality_rules.quality_rules(df).filter("kept").collect()) == [1]
    assert time.time() - began < 60


def mixed_and_mix(spark, rows, columns="doc_id long, text string, source string", **options):
    """Words of each source by the plan and by the mix itself, after checks of both; rows in another order give the same."""
    df = spark.createDataFrame(rows, columns)
    plan = mixing.mix(df, **options).collect()
    assert sorted(map(str, plan)) == sorted(map(str, mixing.mix(df.repartition(5), **options).collect())) and len(plan) == len(rows)
    out = mixing.mixed(df, **options).collect()
    assert sorted(map(str, out)) == sorted(map(str, mixing.mixed(df.repartition(3), **options).collect()))
    assert Counter((r.doc_id, r.source) for r in out) == Counter(k for r in plan for k in [(r.doc_id, r.source)] * r.copies)
    assert all(len(r.shards) == r.copies and r.taken == r.copies * r.size <= 3 * r.size for r in plan)
    by_plan, by_mix, target = Counter(), Counter(), {}
    for r in plan:
        by_plan[r.source] += r.taken
        target[r.source] = r.target
    for r in out:
        by_mix[r.source] += len(WORD.findall(r.text or ""))
    assert by_plan == by_mix
    return by_plan, target


def test_mixing_of_null_and_repeated_ids(spark):
    """Rows without an id, or of one id in several sources, are judged each: every source comes within a row of its target."""
    text = lambda k: " ".join(f"w{k}" for _ in range(10))
    for rows in (
        [(None, text(k), f"s{k % 3}") for k in range(60)],
        [(k, text(k), f"s{j}") for k in range(60) for j in range(3)],
        [(None, "same text in all of these rows ten words long", f"s{k % 3}") for k in range(90)],
        [(7, "one two three", "a")] * 400 + [(k, text(k), "b") for k in range(50)] + [(None, None, "a"), (None, "", None), (8, "x", None)],
    ):
        words, target = mixed_and_mix(spark, rows, docs_per_block=7, shards=4)
        assert all(abs(words[s] - target[s]) <= 10 for s in target)


def test_mixing_of_many_equal_rows(spark, monkeypatch):
    """Equal rows are listed in parts, and rows that differ in a further column only are told apart."""
    monkeypatch.setattr(mixing, "CUT", 16)
    rows = [(1, "a b", "x")] * 250 + [(k, "c d e", "y") for k in range(40)]
    words, target = mixed_and_mix(spark, rows, docs_per_block=20, shards=3)
    assert all(abs(words[s] - target[s]) <= 3 for s in target)
    df = spark.createDataFrame([(None, "a b", "x", {"k": n}) for n in range(30)], "doc_id long, text string, source string, more map<string,int>")
    out = Counter(r.more["k"] for r in mixing.mixed(df).collect())
    assert set(out) == set(range(30)) and set(out.values()) == {1}


def test_words_looked_up_and_merged_together(tmp_path):
    """The same ids as one by one: words of all lengths, any bytes, equal letters, none."""
    import random

    rng, vocabulary = random.Random(4), bpe.Vocabulary(bpe.default_path())
    words = [w.encode() for w in ("", "a", " the", " naïve", "aaaaaaaa", " aaaaaaaaaaaaaaaaaaaaaaa", "\n\n\n", "漢字かな", " \U0001f600", "ab" * 24)]
    words += [bytes(rng.choices(range(256), k=rng.randint(0, 48))) for _ in range(300)] + [(" " + "".join(rng.choices("etaoinshr", k=rng.randint(1, 12)))).encode() for _ in range(2000)]
    assert vocabulary.merge_all(words) == [vocabulary.merge(w) for w in words] and vocabulary.merge_all([]) == []
    path = tmp_path / "lexicon"
    path.write_bytes(bpe.compile_lexicon({w: vocabulary.merge(w) for w in words[1::3]}))
    lexicon = bpe.Lexicon(str(path))
    assert lexicon.get_all(words) == [lexicon.get(w) for w in words] and lexicon.get_all([]) == []
    path.write_bytes(bpe.compile_lexicon({}))
    assert bpe.Lexicon(str(path)).get_all(words[1:]) == [None] * (len(words) - 1)


def test_rounds_of_a_crowded_leaf(spark, monkeypatch):
    """Forms that are all unlike: a round resolves twice as many as the last, and the groups are those of one at a time."""
    import random

    rng, stored_tables, plain = random.Random(3), [], line_dedup.stored
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    tokens = [("read", "more", "about", *rng.sample(words, 6)) for _ in range(360)]
    tokens += [(*t[:8], "other") for t in tokens[:40]]
    rows = [(1, k * 7919 % 1009 - 500, 0, 1 + k % 3, list(t)) for k, t in enumerate(tokens)]
    df = spark.createDataFrame(rows, "leaf long, template long, first_doc long, n_docs long, t array<string>")
    monkeypatch.setattr(line_dedup, "stored", lambda d: stored_tables.append(1) or plain(d))
    got = {r.template: r.rep for r in line_dedup.grouped(df, min_docs=2, reps=8).collect()}
    assert len(stored_tables) <= 3 * 6 + 1
    reps, want = [], {}
    for _, template, _, n, t in sorted(rows, key=lambda r: (-r[3], r[1])):
        found = next((k for k, other in reps if 100 * sum(a == b for a, b in zip(t, other)) >= 70 * len(t)), None)
        if found is None:
            reps.append((template, t))
            found = template
        want[template] = found
    assert got.items() <= want.items() and len(got) >= len(want) - 1
