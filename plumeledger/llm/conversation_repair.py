"""Conversation repair: the cheapest edits that make a conversation's turns alternate, found by a persistent audit DP.

The role initials of a repaired conversation read (s?(ua)+)?. That is an automaton of four states: 0 start, 1 after a
system turn, 2 after a user turn, 3 after an assistant turn; 0 and 3 may end. A path of edits is a linked node
(letter, parent), so that paths share their prefixes; nodes know their ancestors at powers of two and a rolling hash of
the whole path. Equal costs compare by the letter after the longest common prefix, which the ancestors' hashes find by bisection; a
prefix found so is verified letter by letter. At equal cost and state no path is another's prefix (the longer one
would have more inserts and cost more), so the least path of a state always comes from least paths.

A conversation is cut by turn into blocks. A block gives the least path from each state to each state, and a conversation
chains its blocks, so one of any number of turns is no burden to one task: what meets there are costs and
letters, one byte a turn. Turns of one number (or none) stay in one block.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumeledger.llm.shared import importable, with_columns_of, written

#: Turn numbers of a block.
BLOCK = 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ENDS = (0, 3)
#: (state, initial) -> state; a role that is written anew is the one of the two that its state allows.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
WRITTEN = {0: ("user", 2), 1: ("user", 2), 3: ("user", 2), 2: ("assistant", 3)}
_MASK, _BASE = (1 << 61) - 1, 1_000_003


class Paths:
    """Strings of edits as linked nodes; node 0 is the empty one."""

    def __init__(self, base: int = _BASE, mask: int = _MASK):
        self.base, self.mask = base, mask
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [()]

    def push(self, node: int, letter: str) -> int:
        up = [node]
        while (far := self.up[up[-1]]) and len(far) >= len(up):
            up.append(far[len(up) - 1])
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.base + ord(letter)) % self.mask)
        self.up.append(tuple(up))
        return len(self.letter) - 1

    def spell(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _ancestor(self, node: int, depth: int) -> int:
        while (gap := self.depth[node] - depth) > 0:
            node = self.up[node][gap.bit_length() - 1]
        return node

    def _same(self, a: int, b: int) -> bool:
        """Whether two paths of one depth are equal, letter by letter as far as their nodes differ."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether path a comes before path b; a prefix comes before what it begins."""
        d = min(self.depth[a], self.depth[b])
        x, y = self._ancestor(a, d), self._ancestor(b, d)
        if self.hash[x] == self.hash[y]:
            if self._same(x, y):
                return self.depth[a] < self.depth[b]
            return self.spell(a) < self.spell(b)
        for k in reversed(range(len(self.up[x]))):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if self._same(self.up[x][0], self.up[y][0]):
            return self.letter[x] < self.letter[y]
        return self.spell(a) < self.spell(b)


def _offer(paths: Paths, best: dict, state: int, cost: int, node: int) -> None:
    had = best.get(state)
    if had is None or cost < had[0] or cost == had[0] and paths.less(node, had[1]):
        best[state] = cost, node


def _insert(paths: Paths, best: dict) -> dict:
    """best, and what is reached from it by inserts; more than two in a row come back to a state at more cost."""
    layer = best
    for _ in range(2):
        fresh = dict(best)
        for s, (cost, node) in layer.items():
            to = WRITTEN[s][1]
            had = best.get(to)
            if had is None or cost + INSERT <= had[0]:
                _offer(paths, fresh, to, cost + INSERT, paths.push(node, "I"))
        if fresh == best:
            return best
        layer = best = fresh
    return best


def step(paths: Paths, best: dict, initial: str, must_go: bool, truncated: bool) -> dict:
    """{state: (cost, node)} after one more turn; inserts come before it."""
    out: dict = {}
    extra = TRUNCATED * truncated
    for s, (cost, node) in _insert(paths, best).items():
        _offer(paths, out, s, cost + DELETE, paths.push(node, "D"))
        if not must_go:
            if (to := NEXT.get((s, initial))) is not None:
                _offer(paths, out, to, cost + KEEP + extra, paths.push(node, "K"))
            _offer(paths, out, WRITTEN[s][1], cost + REROLE + extra, paths.push(node, "R"))
    return out


def block_table(turns: list[tuple[str, bool, bool]]) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, letters) of the least path through the turns (initial, must go, truncated) for each pair of states that has one."""
    out = []
    for start in range(4):
        paths, best = Paths(), {start: (0, 0)}
        for t in turns:
            best = step(paths, best, *t)
        out += [(start, to, cost, paths.spell(node)) for to, (cost, node) in sorted(best.items())]
    return out


def chain(tables: list[list[tuple[int, int, int, str]]]) -> tuple[int, list[tuple[int, str]]]:
    """Cost and, of each block, (state before it, letters), of the least path through the blocks' tables; closing inserts go to the last."""
    paths, best, back = Paths(), {0: (0, 0)}, []
    for table in tables:
        fresh, came = {}, {}
        for start, to, cost, letters in table:
            if start in best:
                node = best[start][1]
                for x in letters:
                    node = paths.push(node, x)
                _offer(paths, fresh, to, best[start][0] + cost, node)
                if fresh[to][1] == node:
                    came[to] = start, letters
        best = fresh
        back.append(came)
    ends = _insert(paths, best)
    last = None
    for s in ENDS:
        if s in ends and (last is None or ends[s][0] < ends[last][0] or ends[s][0] == ends[last][0] and paths.less(ends[s][1], ends[last][1])):
            last = s
    cost, audit = ends[last][0], paths.spell(ends[last][1])
    for state in best:  # the state before the closing inserts: the one whose path begins the whole
        whole = paths.spell(best[state][1])
        if audit.startswith(whole) and set(audit[len(whole):]) <= {"I"} and best[state][0] + INSERT * (len(audit) - len(whole)) == cost:
            parts, s = [], state
            for came in reversed(back):
                s, letters = came[s]
                parts.append((s, letters))
            parts.reverse()
            if parts:
                parts[-1] = parts[-1][0], parts[-1][1] + audit[len(whole):]
            return cost, parts
    raise AssertionError("a path without its beginning")


def apply(turns: list[tuple[str, str]], state: int, letters: str) -> list[tuple[str, str]]:
    """The (role, text) turns that the letters make of these, from a state on."""
    out, rows = [], iter(turns)
    for x in letters:
        role, text = ("", "") if x == "I" else next(rows)
        if x == "D":
            continue
        if x == "K":
            state = NEXT[state, role[:1]]
        else:
            role, state = WRITTEN[state]
        out.append((role, text))
    return out


# --- on Spark

SPACE = "\t\n\x0b\f\r "


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) damaged as crc32 of `conv_id:turn` mod 20 says; nulls are one space, but for the ids themselves."""
    t = with_columns_of(turns, "conv_id", "turn", "role", "text")
    kind = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    t = t.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return t.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("x")).drop("x")


def blocks(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, block, items): the turns of a block in order (turn, nulls first, then role and text), written to the shared folder.

    An item of kind 0 is no turn but a role and text (digest only) that an earlier block of the conversation has.
    """
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    t = turns.select("conv_id", F.floor(F.col("turn") / block).alias("block"), "turn", "role", "text", F.md5("text").alias("digest"), blank.alias("blank"), (~blank & ~last.isin(".", "!", "?")).alias("truncated"))
    names = ("turn", "role", "text", "digest", "blank", "truncated")
    rows = t.select("conv_id", "block", F.struct(F.lit(1).alias("kind"), *names).alias("item"))
    again = t.select("conv_id", "role", "digest", "block").distinct()
    again = again.withColumn("nth", F.row_number().over(W.partitionBy("conv_id", "role", "digest").orderBy(F.col("block").asc_nulls_first()))).where("nth > 1")
    kinds = {"turn": turns.schema["turn"].dataType, "text": "string", "blank": "boolean", "truncated": "boolean"}
    fields = [F.lit(None).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in names]
    seen = again.select("conv_id", "block", F.struct(F.lit(0).alias("kind"), *fields).alias("item"))
    got = rows.unionAll(seen).groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return written(got, "repair-blocks")


def _summary(items: list[dict]) -> tuple:
    """Counts of a block, its first and last initials, and its table of paths."""
    seen = {(i["role"], i["digest"]) for i in items if not i["kind"]}
    counts, turns, illegal = [0, 0, 0], [], 0
    for i in items:
        if i["kind"]:
            key = i["role"], i["digest"]
            fault = 0 if i["blank"] else 1 if key in seen else 2 if i["truncated"] else None
            seen.add(key)
            if fault is not None:
                counts[fault] += 1
            turns.append((i["role"][:1], fault in (0, 1), fault == 2))
    initials = [t[0] for t in turns]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
    numbers = {i["turn"] for i in items if i["kind"] and i["turn"] is not None}
    table = [dict(zip(("start", "to", "cost", "letters"), r)) for r in block_table(turns)]
    return *counts, illegal, initials[0], initials[-1], min(numbers, default=None), max(numbers, default=None), len(numbers), table


_BLOCK_FIELDS = "blank long, duplicate long, truncated long, illegal long, first string, last string, least long, most long, numbers long, paths array<struct<start:int,to:int,cost:long,letters:string>>"
_PATHS = pa.list_(pa.struct([("start", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())]))
_BLOCK_TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 3 + [_PATHS]


def _each(batches, column: str, work, names: list[str], types: list):
    """Batches with a column of lists replaced by the columns that work(list) gives."""
    for b in batches:
        done = [work(x) for x in b.column(column).to_pylist()]
        kept = [n for n in b.schema.names if n != column]
        yield pa.RecordBatch.from_arrays([b.column(n) for n in kept] + [pa.array([d[k] for d in done], t) for k, t in enumerate(types)], names=kept + names)


def _whole(found: list[dict]) -> tuple:
    """A conversation's counts, cost, letters and parts from those of its blocks, in order."""
    cost, parts = chain([[(p["start"], p["to"], p["cost"], p["letters"]) for p in f["paths"]] for f in found])
    illegal = sum(f["illegal"] for f in found) + sum(x["last"] + y["first"] not in ("su", "ua", "au") for x, y in zip(found, found[1:]))
    low, high = [f["least"] for f in found if f["least"] is not None], [f["most"] for f in found if f["most"] is not None]
    gaps = max(high) - min(low) + 1 - sum(f["numbers"] for f in found) if low else 0
    sums = [sum(f[c] for f in found) for c in ("blank", "duplicate", "truncated")]
    return gaps, *sums, illegal, cost, "".join(p[1] for p in parts), [{"block": f["block"], "state": s, "letters": x} for f, (s, x) in zip(found, parts)]


def audits(cut: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, parts) of each conversation of blocks(); parts: (block, state before it, letters)."""
    importable(cut.sparkSession)
    names = [f.split()[0] for f in _BLOCK_FIELDS.split(", ")]
    narrow = cut.select("conv_id", "block", F.transform("items", lambda i: F.struct(*[i[c].alias(c) for c in ("kind", "role", "digest", "blank", "truncated")], i["turn"].cast("long").alias("turn"))).alias("items"))
    schema = f"conv_id {cut.schema['conv_id'].dataType.simpleString()}, block long"
    one = narrow.mapInArrow(lambda bs: _each(bs, "items", _summary, names, _BLOCK_TYPES), f"{schema}, {_BLOCK_FIELDS}")
    found = one.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", *names))).alias("found"))
    parts = pa.list_(pa.struct([("block", pa.int64()), ("state", pa.int32()), ("letters", pa.string())]))
    out = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, parts array<struct<block:long,state:int,letters:string>>"
    own = [f.split()[0] for f in out.split(", ")]
    return found.mapInArrow(lambda bs: _each(bs, "found", _whole, own, [pa.int64()] * 6 + [pa.string(), parts]), f"{schema.split(',')[0]}, {out}")


def repaired(cut: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, block, turns): the repaired turns (role, text) of each block, in order; a block may have none."""
    p = plans.select(F.col("conv_id").alias("of"), F.explode("parts").alias("p")).select("of", F.col("p.block").alias("at"), "p.state", "p.letters")
    both = cut.join(p.hint("merge"), cut.conv_id.eqNullSafe(p.of) & cut.block.eqNullSafe(p.at))
    item = F.transform(F.filter("items", lambda i: i["kind"] == 1), lambda i: F.struct(i["role"].alias("role"), i["text"].alias("text")))
    job = both.select("conv_id", "block", F.struct(item.alias("turns"), "state", "letters").alias("job"))
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def work(j):
        return ([dict(role=r, text=t) for r, t in apply([(x["role"], x["text"]) for x in j["turns"]], j["state"], j["letters"])],)

    kind = cut.schema["conv_id"].dataType.simpleString()
    return job.mapInArrow(lambda bs: _each(bs, "job", work, ["turns"], [turn]), f"conv_id {kind}, block long, turns array<struct<role:string,text:string>>")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired(): SHA-256 of `role:text` of all turns, joined by line feeds, as a stream in order of blocks."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    rows = turns.select("conv_id", "block", F.when(F.size("turns") > 0, lines).alias("lines"))
    rows = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("block").asc_nulls_first()).drop("block")

    def run(batches):
        own, sha, empty, schema = None, None, True, None
        for b in batches:
            schema, ids, hashes = b.schema.field("conv_id").type, [], []
            for conv, text in zip(b.column("conv_id").to_pylist(), b.column("lines").to_pylist()):
                if sha is None or conv != own:
                    if sha is not None:
                        ids.append(own)
                        hashes.append(sha.hexdigest())
                    own, sha, empty = conv, hashlib.sha256(), True
                if text is not None:
                    sha.update(("" if empty else "\n").encode() + text.encode())
                    empty = False
            yield pa.RecordBatch.from_arrays([pa.array(ids, schema), pa.array(hashes, pa.string())], names=["conv_id", "repaired_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own], schema), pa.array([sha.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    return rows.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair(turns: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(audits, repaired) of the conversations of turns (conv_id, turn, role, text), which have no null role or text.

    Rows of null conv_id are one conversation. Equal turn numbers are ordered by role and text; repeated rows are
    duplicates of the first. A role that begins with none of s, u and a (an empty one too) is written anew or goes. An empty table gives no rows.
    """
    cut = blocks(turns, block)
    plans = written(audits(cut), "repair-audits")
    return plans, repaired(cut, plans)


def op13_conversation_repair(spark, sf_dir) -> DataFrame:
    """Every conversation of the table, after damage."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    plans, fixed = repair(damage(turns))
    ids, shas = turns.select("conv_id").distinct(), digests(fixed).withColumnRenamed("conv_id", "of")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    p = plans.select(F.col("conv_id").alias("id"), *counts, "audit")
    got = ids.join(p.hint("merge"), ids.conv_id.eqNullSafe(p.id), "left").join(shas.hint("merge"), ids.conv_id.eqNullSafe(shas.of), "left")
    values = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts]
    sha: Column = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))
    return got.select("conv_id", *values, F.coalesce("audit", F.lit("")).alias("audit"), sha.alias("repaired_sha256"))
