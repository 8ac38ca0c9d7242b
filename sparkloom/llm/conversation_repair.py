"""Conversation structure repair by signatures: role and fault sequences as compact strings, each distinct one solved once.

A conversation's rows, in order of turn (nulls first), are read as letters: D for a row that has to go (blank, or its role
and text were there before), else the role's initial s, u, a, or x for any other, as a capital if the row's text is truncated. Letters
make signatures of PIECE rows at most: a conversation of up to PIECE rows is one piece, a longer one several. A memoised recursion over
suffixes gives, for each distinct signature, the cheapest edits from every state of the wanted order `(s?(ua)+)?` to every other one: 0
before any row, 1 after s, 2 after u, 3 after a. Among edits of one cost the least string counts. The tables are joined back to the
pieces; those of long conversations are put together in order, as a running minimum over four states, and the edits are replayed.

An edit string of a piece ends with a row's letter (inserts come before the row they precede), so none begins another, and least strings
of pieces make the least string of the whole.

Cases: nulls read as one space; a null conv_id is a conversation; rows of equal turns follow their role, then a hash of role and text; a conversation whose rows
are all gone has zeros and empty strings; very long texts are taken whole; a conversation may have any number of rows: it is sorted
and cut without meeting in one task, but for a stream of its pieces' costs (one row for PIECE rows), its edit string, and the digest of
its repaired text, which is taken in order, batch by batch; empty table, empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm._base import dropped, small, stored

PIECE = 200
#: What a task remembers of suffixes before it forgets them all.
REMEMBERED = 10_000
BLANKS = " \t\n\x0b\x0c\r"
#: Costs: Rerole, Delete, Insert, an undeleted truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Inserts that lead from one state to another: {from: [(state, how many), ...]}.
INSERTS = {0: [(0, 0), (2, 1), (3, 2)], 1: [(1, 0), (2, 1), (3, 2)], 2: [(2, 0), (3, 1)], 3: [(3, 0), (2, 1)]}
#: Inserts that end the order properly.
FINISH = {0: 0, 1: 2, 2: 1, 3: 0}
ROLES = {2: "user", 3: "assistant"}


def step(p: int, letter: str):
    """(edit, cost, next state) of a row's letter in state p, without inserts."""
    yield "D", DELETE, p
    if letter != "D":
        extra = TRUNCATED * letter.isupper()
        kept = {"s": 1 if p == 0 else None, "u": 2 if p != 2 else None, "a": 3 if p == 2 else None}.get(letter.lower())
        if kept:
            yield "K", extra, kept
        yield "R", REROLE + extra, 3 if p == 2 else 2


def solve(signature: str, known: dict) -> list[dict]:
    """For each state before the signature {state after it: (cost, edits)}, by recursion over its suffixes, which `known` remembers."""
    if not signature:
        return [{p: (0, "")} for p in range(4)]
    if signature in known:
        return known[signature]
    rest, out = solve(signature[1:], known), []
    for p in range(4):
        best: dict = {}
        for q, n in INSERTS[p]:
            for edit, cost, nxt in step(q, signature[0]):
                for end, (more, edits) in rest[nxt].items():
                    found = (INSERT * n + cost + more, "I" * n + edit + edits)
                    if end not in best or found < best[end]:
                        best[end] = found
        out.append(best)
    if len(known) >= REMEMBERED:
        known.clear()
    known[signature] = out
    return out


def finished(table: list[dict]) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    return min((cost + INSERT * FINISH[q], edits + "I" * FINISH[q]) for q, (cost, edits) in table[0].items())


def replayed(edits: str, roles: list, texts: list, state: int) -> list[dict]:
    """The rows after the edits, from a state on."""
    out, at = [], 0
    for edit in edits:
        if edit == "D":
            at += 1
            continue
        first = edit == "K" and state == 0 and roles[at][:1] == "s"
        state = 1 if first else 3 if state == 2 else 2
        if edit == "I":
            out.append({"role": ROLES[state], "text": ""})
            continue
        out.append({"role": ROLES[state] if edit == "R" else roles[at], "text": texts[at]})
        at += 1
    return out


def _solved(batches):
    """signature, whole to cost, edits, steps (all states' tables; none where only whole conversations read so)."""
    known: dict = {}
    for b in batches:
        rows = []
        for s, whole in zip(b["signature"], b["whole"]):
            table = solve(s, known)
            cost, edits = finished(table)
            rows.append((s, cost, edits, [] if whole else [{"p": p, "q": q, "cost": c, "edits": e} for p in range(4) for q, (c, e) in sorted(table[p].items())]))
        yield pd.DataFrame(rows, columns=["signature", "cost", "edits", "steps"])


SOLVED = "signature string, cost long, edits string, steps array<struct<p: int, q: int, cost: bigint, edits: string>>"


def coded(rows: DataFrame) -> DataFrame:
    """conv_id, n, row (turn, role, key, text, code); code: the role's initial or x, and b for a blank text, t for a truncated one, else -."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), "n")
    tail = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    initial = F.substring("role", 1, 1)
    code = F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("x"), F.when(tail == "", "b").when(tail.isin(".", "!", "?"), "-").otherwise("t"))
    return rows.select("conv_id", "n", F.struct("turn", "role", F.xxhash64("role", "text").alias("key"), "text", code.alias("code")).alias("row"))


def short_pieces(rows: DataFrame) -> DataFrame:
    """conv_id, piece (0), rows, again (which rows were there before) of conversations of PIECE rows at most."""
    by = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct("row", "n")))).alias("found"))
    by = by.select("conv_id", F.lit(0).cast("long").alias("piece"), F.flatten(F.transform("found", lambda x: F.array_repeat(x["row"], x["n"]))).alias("rows"))
    # a row's key stands earlier if its first place isn't the row's own
    return by.withColumn("again", F.transform("rows", lambda r, i: F.array_position(F.col("rows.key"), r["key"]) <= i))


def long_pieces(rows: DataFrame, piece: int) -> DataFrame:
    """The same for longer ones: rows are dealt by range, so that no conversation lies in one task, and ranked by the ranges' counts."""
    rows = rows.filter("n > 0").withColumn("copy", F.explode(F.expr("sequence(1, n)"))).drop("n").withColumn("salt", F.monotonically_increasing_id())
    rows = stored(rows)
    tasks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["row.turn", "row.role", "row.key", "salt"]
    dealt = stored(rows.repartitionByRange(tasks, "conv_id", *order).withColumn("range", F.spark_partition_id()))
    own = Window.partitionBy("conv_id", "range").orderBy(*order)
    counts = dealt.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stored(counts.select("conv_id", "range", before.alias("before")))
    at = small(offsets.withColumnsRenamed({"conv_id": "of", "range": "part"}))
    placed = dealt.withColumn("i", F.row_number().over(own)).join(at, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("range") == F.col("part")))
    placed = stored(placed.select("conv_id", "row", (F.col("i") - 1 + F.col("before")).cast("long").alias("place")))
    first = placed.groupBy("conv_id", F.col("row.key").alias("key")).agg(F.min("place").alias("place")).select(F.col("conv_id").alias("of"), F.col("place").alias("at"))
    rows = placed.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("place") == F.col("at")), "left").withColumn("again", F.col("at").isNull())
    by = rows.groupBy("conv_id", F.floor(F.col("place") / piece).cast("long").alias("piece")).agg(F.sort_array(F.collect_list(F.struct("place", "row", "again"))).alias("x"))
    out = stored(by.select("conv_id", "piece", F.col("x.row").alias("rows"), F.col("x.again").alias("again")))
    dropped(dealt, offsets, placed)
    return out


def pieces(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id, whole (whether it is the conversation's only piece), piece, rows, signature and the piece's counts, stored.
    rows: conv_id, turn, role, text, n (how often the row is there; 0: only its conv_id is)."""
    rows = coded(rows)
    long = stored(rows.groupBy("conv_id").agg(F.sum("n").alias("n")).filter(F.col("n") > piece).select(F.col("conv_id").alias("of")))
    if long.isEmpty():
        found = short_pieces(rows).withColumn("whole", F.lit(True))
    else:
        of_long = F.col("conv_id").eqNullSafe(F.col("of"))
        found = short_pieces(rows.join(small(long), of_long, "left_anti")).withColumn("whole", F.lit(True))
        found = found.unionByName(long_pieces(rows.join(small(long), of_long, "left_semi"), piece).withColumn("whole", F.lit(False)))
    code = F.col("rows.code")
    letter = lambda c, again: F.when(again | c.endswith("b"), "D").when(c.endswith("t"), F.upper(F.substring(c, 1, 1))).otherwise(F.substring(c, 1, 1))
    initials = F.array_join(F.transform(code, lambda c: F.substring(c, 1, 1)), "")
    found = found.withColumn("signature", F.array_join(F.zip_with(code, "again", letter), "")).withColumn("initials", initials)
    n = F.size("rows")
    blank = F.size(F.filter(code, lambda c: c.endswith("b"))).cast("long")
    times = lambda col, chars: F.length(col) - F.length(F.translate(col, chars, ""))
    turns = F.filter(F.col("rows.turn"), lambda t: t.isNotNull())
    return stored(
        found.select(
            "conv_id", "whole", "piece", "rows", "signature", "initials",
            blank.alias("blank"),
            (times("signature", "D") - blank).cast("long").alias("duplicate"),
            times("signature", "SUAX").cast("long").alias("truncated"),
            (F.greatest(n - 1, F.lit(0)) - F.regexp_count("initials", F.lit("(?=su|ua|au)"))).cast("long").alias("illegal"),
            F.array_min(turns).alias("least"), F.array_max(turns).alias("most"), F.size(F.array_distinct(turns)).cast("long").alias("turns"),
        )
    )


def solutions(found: DataFrame) -> DataFrame:
    """SOLVED of every distinct signature, stored."""
    return stored(found.groupBy("signature").agg(F.min("whole").alias("whole")).mapInPandas(_solved, SOLVED))


def _chained(batches):
    """Pieces of long conversations, in order, to (conv_id, piece, p, q, tail, cost, bound): the states that a piece leads from and to on
    the cheapest way, the inserts behind the last piece, and at the last piece the whole cost. bound: illegal pairs and repeated turns
    where pieces meet. A piece's steps come with their edits, by which equal costs are told apart."""
    conv, ways, back, met = None, None, [], []

    def done():
        if ways is None:
            return None
        end = min(ways, key=lambda q: (ways[q][0] + INSERT * FINISH[q], ways[q][1]))
        cost, q, out = ways[end][0] + INSERT * FINISH[end], end, []
        for piece, came in reversed(back):
            out.append((conv[0], piece, came[q], q, "I" * FINISH[end] if q == end and not out else "", cost if not out else None))
            q = came[q]
        rows = pd.DataFrame(out[::-1], columns=["conv_id", "piece", "p", "q", "tail", "cost"])
        rows["illegal"], rows["shared"] = zip(*met)
        return rows.astype({"cost": "Int64"})

    last = None
    for b in batches:
        for r in b.itertuples(index=False):
            one = (r.conv_id,)
            if one != conv:
                if (rows := done()) is not None:
                    yield rows
                conv, ways, back, met, last = one, {0: (0, 0)}, [], [], None
            tables: dict = defaultdict(dict)
            for s in r.steps:
                tables[s["p"]][s["q"]] = (s["cost"], s["edits"])
            best = {}
            for p, (cost, rank) in ways.items():
                for q, (more, edits) in tables[p].items():
                    way = (cost + more, (rank, edits), p)
                    if q not in best or way[:2] < best[q][:2]:
                        best[q] = way
            order = {key: k for k, key in enumerate(sorted({w[1] for w in best.values()}))}
            ways = {q: (cost, order[key]) for q, (cost, key, _) in best.items()}
            back.append((r.piece, {q: p for q, (_, _, p) in best.items()}))
            pair = last[0] + r.initials[:1] if last else "su"
            met.append((int(pair not in ("su", "ua", "au")), int(last is not None and last[1] is not None and last[1] == r.first_turn)))
            last = (r.initials[-1:], r.last_turn)
    if (rows := done()) is not None:
        yield rows


CHAINED = "conv_id string, piece long, p int, q int, tail string, cost long, illegal long, shared long"


def _replay(edits: pd.Series, roles: pd.Series, texts: pd.Series, state: pd.Series) -> pd.Series:
    return pd.Series([replayed(e, list(r), list(t), s) for e, r, t, s in zip(edits, roles, texts, state)], dtype=object)


def repaired_pieces(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """Every piece with its counts, edits, cost (null but in the last piece of a long conversation) and repaired rows, stored."""
    found = pieces(rows, piece)
    solved = solutions(found)
    whole = found.filter("whole").join(solved.drop("steps"), "signature").withColumn("state", F.lit(0))
    out = whole
    long = found.filter("NOT whole")
    if not long.isEmpty():
        turn = F.col("rows.turn")
        text = lambda c: c.cast("string")  # noqa: E731  pandas would make nullable numbers floats
        ends = text(F.get(turn, F.lit(0))).alias("first_turn"), text(F.element_at(turn, -1)).alias("last_turn")
        light = long.select(text(F.col("conv_id")).alias("conv_id"), "piece", "signature", "initials", *ends)
        light = light.join(solved.select("signature", "steps"), "signature").drop("signature")
        ways = stored(light.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInPandas(_chained, CHAINED))
        ways = ways.withColumn("conv_id", F.col("conv_id").cast("long")).withColumnsRenamed({"conv_id": "of", "piece": "part", "illegal": "met"})
        far = long.join(small(ways), F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("piece") == F.col("part"))).join(solved.select("signature", "steps"), "signature")
        edits = F.concat(F.get(F.filter("steps", lambda s: (s["p"] == F.col("p")) & (s["q"] == F.col("q"))), F.lit(0))["edits"], "tail")
        far = far.withColumn("edits", edits).withColumn("illegal", F.col("illegal") + F.col("met")).withColumn("turns", F.col("turns") - F.col("shared"))
        out = whole.unionByName(far.withColumn("state", F.col("p")).select(whole.columns))
    replay = F.pandas_udf(_replay, "array<struct<role: string, text: string>>")
    done = stored(out.withColumn("repaired", replay("edits", "rows.role", "rows.text", "state")).drop("rows", "signature", "initials", "state"))
    dropped(found, solved)
    return done


def report(done: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation. done: repaired_pieces(rows)."""
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    wide = lambda c: c.cast("decimal(20, 0)")
    gaps = F.coalesce((wide(F.max("most")) - wide(F.min("least")) + 1 - F.sum("turns")).cast("decimal(20, 0)"), F.lit(0)).try_cast("long")
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "edits"))), lambda x: x["edits"]), "")
    long = done.filter("NOT whole").groupBy("conv_id").agg(gaps.alias("gaps"), *sums, F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"), audit.alias("audit"))
    one = F.coalesce(wide(F.col("most")) - wide(F.col("least")) + 1 - F.col("turns"), F.lit(0)).try_cast("long")
    short = done.filter("whole").select("conv_id", one.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", F.col("edits").alias("audit"))
    return short.unionByName(long)


def repair(rows: DataFrame, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """The report, and the repaired conversations: conv_id, place, role, text. rows: conv_id, turn, role, text."""
    done = repaired_pieces(rows.select("conv_id", "turn", "role", "text", F.lit(1).alias("n")), piece)
    texts = done.select("conv_id", "piece", F.posexplode("repaired").alias("i", "x"))
    return report(done), texts.select("conv_id", F.struct("piece", "i").alias("place"), "x.role", "x.text")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: faults by the crc32 of conv_id:turn, as n and in the row itself."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("fault"))
    out = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    n = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), out.alias("text"), n.alias("n"))


def _digests(batches):
    """The SHA-256 of each conversation's rows, from its pieces in order."""
    conv, sha, some = None, None, False
    for b in batches:
        done = []
        for c, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if (c,) != conv:
                if conv:
                    done.append((conv[0], sha.hexdigest()))
                conv, sha, some = (c,), hashlib.sha256(), False
            if text is not None:
                sha.update((b"\n" if some else b"") + text.encode())
                some = True
        yield pa.RecordBatch.from_pylist([{"conv_id": c, "repaired_sha256": h} for c, h in done], schema=DIGEST)
    if conv:
        yield pa.RecordBatch.from_pylist([{"conv_id": conv[0], "repaired_sha256": sha.hexdigest()}], schema=DIGEST)


DIGEST = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def digests(done: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256. A long conversation's pieces pass through one task as a stream, since a digest has to be taken in order."""
    text = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    short = done.filter("whole").select("conv_id", F.sha2(text, 256).alias("repaired_sha256"))
    long = done.filter("NOT whole").select("conv_id", "piece", F.when(F.size("repaired") > 0, text).alias("t"))
    long = long.repartition("conv_id").sortWithinPartitions("conv_id", "piece").select("conv_id", "t")
    return short.unionByName(long.mapInArrow(_digests, "conv_id long, repaired_sha256 string"))


def digested(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    done = repaired_pieces(rows, piece)
    sha = digests(done).withColumnRenamed("conv_id", "of")
    return report(done).join(sha, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")


def query(spark, sf_dir):
    return digested(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
