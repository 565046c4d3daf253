"""Least-cost repair of the turn structure of conversations by parallel Viterbi with rank convergence.

Wanted are role initials ``(s?(ua)+)?``. Turns are kept, given another role (user or assistant), deleted, or
empty ones inserted; the cheapest edits are a shortest path through four states (nothing yet, after system, after
user, after assistant). Conversations are cut into chunks of at most 512 consecutive turns. Each chunk computes
the cost of going on from each state at its start, backwards from a guessed cost vector at its end. Fix-up passes
then compare each guess with the vector that the next chunk has found: where they differ by more than a constant,
the chunk runs again from the new vector, and only until the old and the new run differ by a constant; the rest of
the chunk stays as it was. With no chunk left to mend, the constants add up to the cost of the conversation.
Tracing goes forward by those costs and takes the least letter (D, I, K, R) that is on a cheapest path. Which
state a chunk is entered in follows from the exits that the chunks before it have for each entry, joined by doubling.

Turns are ordered by turn (nulls first), role and a digest of role and text, by range, so that a conversation with a
third of all rows is dealt over many tasks. Up to the edits only these keys move, no texts. A turn equal in role and
text to an earlier one is found by the digest (128 bits of SHA-256). Texts meet their edits by the same keys.
A digest over a whole repaired conversation is made by streaming it through one task in order, in bounded memory.

Defined cases: null role and text are one space; null conversations are one conversation; turns without a number
come first; ties go by role and digest; equal rows are duplicates of one another; an empty table has no edits;
columns other than the four are left out, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kinweave.llm.words import small_batches
from kinweave.session import stage

#: Turns of a chunk as a power of two.
CHUNK_BITS = 9
RENAME, DELETE, TRUNCATED, INSERT = 1, 2, 5, 5
_INK = r"[^\x20\x09-\x0D]"
_BEGIN, _SYSTEM, _USER, _ASSISTANT = range(4)
#: State after an inserted or renamed turn, and the initial of its role.
_FORCED = (_USER, _USER, _ASSISTANT, _USER)
_INITIAL = " sua"
_NAMES = {"u": "user", "a": "assistant"}
#: Cost of the inserts that complete a conversation from each state: nothing, "ua", "a", nothing.
_END = (0, 2 * INSERT, INSERT, 0)
# A turn is a letter: "a" + 4 * (role initial: s, u, a, other) + (fault: none, truncated, blank, duplicate).
_CLASSES = "suax"
_TO_CLASS = ("abcdefghijklmnop", "ssssuuuuaaaaxxxx")
_KEYS = ["conv", "turn", "role", "digest"]

Vector = tuple[int, ...]
_steps: dict[tuple[str, Vector], tuple[Vector, int]] = {}
_moves: dict[tuple[str, Vector, int], tuple[str, str, str, int]] = {}


def _edits(letter: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of what may be done with the turn itself."""
    kind, fault = divmod(ord(letter) - 97, 4)
    out = [("D", DELETE, state)]
    if fault < 2:
        extra = TRUNCATED * fault
        if (kind, state) in ((0, _BEGIN), (1, _BEGIN), (1, _SYSTEM), (1, _ASSISTANT), (2, _USER)):
            out.append(("K", extra, kind + 1))
        out.append(("R", extra + RENAME, _FORCED[state]))
    return out


def _before(letter: str, after: Vector) -> list[int]:
    """Cost of going on from each state before a turn, given the costs after it."""
    cost = [min(c + after[to] for _, c, to in _edits(letter, s)) for s in range(4)]
    user, assistant = cost[_USER], cost[_ASSISTANT]
    cost[_USER], cost[_ASSISTANT] = min(user, INSERT + assistant), min(assistant, INSERT + user)
    for s in (_BEGIN, _SYSTEM):
        cost[s] = min(cost[s], INSERT + cost[_USER])
    return cost


def step(letter: str, after: Vector) -> tuple[Vector, int]:
    """Vector before a turn, reduced to a least cost of 0, and the constant taken off."""
    known = _steps.get((letter, after))
    if known is None:
        cost = _before(letter, after)
        known = _steps[letter, after] = (tuple(c - min(cost) for c in cost), min(cost))
    return known


def move(letter: str, after: Vector, state: int) -> tuple[str, str, str, int]:
    """(initials of inserts before, edit, new initial if renamed, next state) of the least letters on a cheapest path."""
    key = (letter, after, state)
    known = _moves.get(key)
    if known is None:
        cost, inserted = _before(letter, after), ""
        while known is None:
            ways = {edit: (c, to) for edit, c, to in _edits(letter, state)}
            ways["I"] = (INSERT, _FORCED[state])
            for edit in sorted(ways):
                c, to = ways[edit]
                if c + (cost if edit == "I" else after)[to] == cost[state]:
                    break
            if edit == "I":
                inserted, state = inserted + _INITIAL[to], to
            else:
                known = _moves[key] = (inserted, edit, _INITIAL[to] if edit == "R" else "", to)
    return known


def backward(letters: str, end: Vector) -> tuple[Vector, int]:
    """Vector at the start of a chunk and the sum of constants, from the vector at its end."""
    total = 0
    for letter in reversed(letters):
        end, shift = step(letter, end)
        total += shift
    return end, total


def mend(letters: str, old: Vector, new: Vector, start: Vector, total: int) -> tuple[Vector, int]:
    """``backward`` from ``new``, given its result (``start``, ``total``) from ``old``; stops where both runs agree."""
    for letter in reversed(letters):
        if old == new:
            return start, total
        old, a = step(letter, old)
        new, b = step(letter, new)
        total += b - a
    return new, total


def vectors_after(letters: str, end: Vector) -> list[Vector]:
    """The vector after each turn of a chunk."""
    out = [end]
    for letter in reversed(letters[1:]):
        out.append(step(letter, out[-1])[0])
    return out[::-1]


def exits(letters: str, end: Vector) -> list[int]:
    """State in which a chunk is left, for each state it is entered in."""
    after, states = vectors_after(letters, end), [0, 1, 2, 3]
    for letter, vector in zip(letters, after):
        to = {s: move(letter, vector, s)[3] for s in set(states)}
        states = [to[s] for s in states]
    return states


def trace(letters: str, end: Vector, state: int, last: bool) -> list[tuple[str, str, str, str]]:
    """(initials inserted before, edit, new initial, initials inserted after) of each turn of a chunk."""
    out = []
    for letter, vector in zip(letters, vectors_after(letters, end)):
        before, edit, to, state = move(letter, vector, state)
        out.append((before, edit, to, ""))
    if last and state in (_SYSTEM, _USER):
        out[-1] = (*out[-1][:3], "ua" if state == _SYSTEM else "a")
    return out


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, fault, id), written out in order; ``id`` grows by one within a task's rows."""
    text = F.col("text")
    ink = F.regexp_extract(text, rf"({_INK})[\x20\x09-\x0D]*\z", 1)
    facts = turns.select(
        "conv", "turn", "role", digest_of(F.col("role"), text).alias("digest"),
        F.when(ink == "", 2).when(~ink.isin(".", "!", "?"), 1).otherwise(0).alias("fault"))
    keys = [F.col(k).asc_nulls_first() for k in _KEYS]
    return stage(facts.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("id", F.monotonically_increasing_id()), "turns")


def digest_of(role: Column, text: Column) -> Column:
    whole = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return F.substring(F.unhex(whole), 1, 16)


def chunks_of(rows: DataFrame) -> DataFrame:
    """(conv, head, letters), written out: each chunk by the id of its first turn."""
    first = rows.groupBy("conv", "digest").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("first"))
    kind = F.instr(F.lit(_CLASSES[:3]), F.substring("role", 1, 1))
    kind = F.when((F.length("role") == 0) | (kind == 0), 3).otherwise(kind - 1)
    fault = F.when(F.col("fault") == 2, 2).when(F.col("first").isNull(), 3).otherwise(F.col("fault"))
    coded = rows.join(first, "id", "left").select("conv", "id", F.char(97 + 4 * kind + fault).alias("letter"))
    own = F.array_sort(F.collect_list(F.struct("id", "letter")))
    return stage(coded.groupBy("conv", F.shiftright("id", CHUNK_BITS).alias("block")).agg(
        F.min("id").alias("head"), F.array_join(F.transform(own, lambda x: x["letter"]), "").alias("letters")).drop("block"), "chunks")


def links_of(chunks: DataFrame) -> DataFrame:
    """(head, next), written out: each chunk that another of its conversation follows."""
    heads = chunks.select("conv", F.shiftright("head", 33).alias("part"), "head")
    inside = heads.withColumn("next", F.lead("head").over(Window.partitionBy("conv", "part").orderBy("head")))
    # a conversation over several tasks: the last chunk of one goes on in the first of the next
    spans = heads.groupBy("conv", "part").agg(F.min("head").alias("low"), F.max("head").alias("head"))
    across = spans.select("head", F.lead("low").over(Window.partitionBy("conv").orderBy("part")).alias("across")).where("across IS NOT NULL")
    return stage(inside.join(across, "head", "left").select("head", F.coalesce("next", "across").alias("next")).where("next IS NOT NULL"), "links")


_VECTORS = "head long, end array<int>, start array<int>, total long"


def _table(rows: list[tuple], schema: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.values())], list(schema))


_VECTOR_TYPES = {"head": pa.int64(), "end": pa.list_(pa.int32()), "start": pa.list_(pa.int32()), "total": pa.int64()}


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _table([(r["head"], list(_END), *backward(r["letters"], _END)) for r in batch.to_pylist()], _VECTOR_TYPES)


def _rerun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _table([(r["head"], r["found"], *mend(r["letters"], tuple(r["end"]), tuple(r["found"]), tuple(r["start"]), r["total"]))
                      for r in batch.to_pylist()], _VECTOR_TYPES)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _table([(r["head"], r["prev"], exits(r["letters"], tuple(r["end"]))) for r in batch.to_pylist()],
                     {"head": pa.int64(), "prev": pa.int64(), "exits": pa.list_(pa.int32())})


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"id": pa.int64(), "before": pa.string(), "edit": pa.string(), "initial": pa.string(), "after": pa.string()}
    for batch in batches:
        yield _table([(r["head"] + k, *found) for r in batch.to_pylist()
                      for k, found in enumerate(trace(r["letters"], tuple(r["end"]), r["entry"], r["last"]))], kinds)


def converged(chunks: DataFrame, links: DataFrame) -> DataFrame:
    """(head, end, start, total): true vectors of all chunks up to constants, by fix-up passes until none changes."""
    vectors = stage(chunks.select("head", "letters").mapInArrow(_run, _VECTORS), "vectors")
    while True:
        found = vectors.select(F.col("head").alias("next"), F.col("start").alias("found"))
        stale = stage(vectors.join(links, "head").join(found, "next").where("end != found").drop("next"), "stale")
        if stale.isEmpty():
            return vectors
        mended = stale.join(chunks.select("head", "letters"), "head").mapInArrow(_rerun, _VECTORS)
        vectors = stage(vectors.join(stale.select("head"), "head", "left_anti").unionByName(mended), "vectors")


def entries(chunks: DataFrame, links: DataFrame, vectors: DataFrame) -> DataFrame:
    """(head, entry): the state in which each chunk that follows another is entered."""
    linked = links.select("head").union(links.select("next")).distinct()
    before = links.select(F.col("head").alias("prev"), F.col("next").alias("head"))
    known = linked.join(before, "head", "left").join(vectors.select("head", "end"), "head").join(chunks.select("head", "letters"), "head")
    maps = stage(known.mapInArrow(_exits, "head long, prev long, exits array<int>"), "exits")
    while True:
        # an exit that no entry changes needs no look back; a first chunk is entered at the beginning
        settled = F.when(F.col("prev").isNull(), F.transform("exits", lambda _: F.get("exits", F.lit(_BEGIN)))).otherwise(F.col("exits"))
        maps = maps.withColumn("exits", settled).withColumn("prev", F.when(F.size(F.array_distinct("exits")) > 1, F.col("prev")))
        if maps.where("prev IS NOT NULL").isEmpty():
            left = maps.select(F.col("head").alias("prev"), F.get("exits", F.lit(0)).alias("entry"))
            return before.join(left, "prev").select("head", "entry")
        back = maps.select(F.col("head").alias("prev"), F.col("prev").alias("further"), F.col("exits").alias("there"))
        maps = stage(maps.join(back, "prev", "left").select(
            "head", F.col("further").alias("prev"),
            F.when(F.col("there").isNull(), F.col("exits")).otherwise(F.transform("there", lambda s: F.get("exits", s))).alias("exits")), "exits")


def _normal(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    spaced = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), spaced(role_col).alias("role"), spaced(text_col).alias("text"))


class Repair:
    """Tables of one repair: ``rows``, ``chunks``, ``links``, ``vectors`` and ``edits`` (one row for each turn)."""

    def __init__(self, turns: DataFrame) -> None:
        small_batches(turns.sparkSession)
        self.turns = turns
        self.rows = ordered_turns(turns)
        self.chunks = chunks_of(self.rows)
        self.links = links_of(self.chunks)
        self.vectors = converged(self.chunks, self.links)
        starts = entries(self.chunks, self.links, self.vectors)
        chosen = self.chunks.select("head", "letters").join(self.vectors.select("head", "end"), "head").join(starts, "head", "left").join(
            self.links, "head", "left").select("head", "letters", "end", F.coalesce("entry", F.lit(_BEGIN)).alias("entry"), F.col("next").isNull().alias("last"))
        self.edits = stage(chosen.mapInArrow(_trace, "id long, before string, edit string, initial string, after string"), "edits")

    def merged(self, *deal: str) -> DataFrame:
        """Texts and edits of equal keys, the text first, dealt by ``deal`` and in order within a task."""
        edits = self.edits.join(self.rows.select("id", *_KEYS), "id").select(*_KEYS, "id", "before", "edit", "initial", "after", F.lit(None).cast("string").alias("text"))
        texts = self.turns.select("conv", "turn", "role", digest_of(F.col("role"), F.col("text")).alias("digest"), *[
            F.lit(None).cast(k).alias(c) for c, k in (("id", "long"), ("before", "string"), ("edit", "string"), ("initial", "string"), ("after", "string"))], "text")
        order = [F.col(k).asc_nulls_first() for k in [*_KEYS, "id"]]
        return edits.unionByName(texts).repartition(*deal).sortWithinPartitions(*order)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, int, str, str, list[tuple[str, str, str]]]]:
    """(conv, id, letters, edit, lines) of each turn in order; a line is (role, text, edit)."""
    text, of = "", None
    for batch in batches:
        for r in batch.to_pylist():
            key = (r["conv"], r["turn"], r["role"], r["digest"])
            if r["id"] is None:
                if key != of:
                    text, of = r["text"], key
                continue
            lines = [(_NAMES[x], "", "I") for x in r["before"]]
            if r["edit"] != "D":
                lines.append((_NAMES[r["initial"]] if r["edit"] == "R" else r["role"], text, r["edit"]))
            lines += [(_NAMES[x], "", "I") for x in r["after"]]
            yield r["conv"], r["id"], "I" * len(r["before"]) + r["edit"] + "I" * len(r["after"]), r["edit"], lines


def repaired_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """(<conv_col>, place, step, role, text, edit): the turns of all repaired conversations, in order of place and step;
    ``edit`` is K for kept, R for another role and I for inserted turns."""
    turns = _normal(conversations, conv_col, turn_col, role_col, text_col)
    kind = turns.schema["conv"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, id_, _, _, lines in _repaired(batches):
            if lines:
                yield pa.RecordBatch.from_pylist([{"conv": conv, "place": id_, "step": k, "role": a, "text": b, "edit": c} for k, (a, b, c) in enumerate(lines)], schema)

    schema = pa.schema([("conv", to_arrow_type(turns.schema["conv"].dataType)), ("place", pa.int64()), ("step", pa.int32()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    return Repair(turns).merged(*_KEYS).mapInArrow(emit, f"conv {kind}, place long, step int, role string, text string, edit string").withColumnRenamed("conv", conv_col)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with a fifth of the turns damaged by a hash: dropped, emptied, cut, repeated or given the role user."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), h.alias("h")).where("h != 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


_NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair_report(originals: DataFrame, conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(<conv_col>, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of
    ``originals``, as found and repaired in ``conversations``."""
    turns = _normal(conversations, conv_col, turn_col, role_col, text_col)
    repair = Repair(turns)
    kind = turns.schema["conv"].dataType.simpleString()
    schema = pa.schema([("conv", to_arrow_type(turns.schema["conv"].dataType)), ("audit", pa.string()), ("sha", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list = []
        ready: list[dict] = []
        for conv, _, letters, _, lines in _repaired(batches):
            if not own or own[0] != conv:
                ready += [{"conv": own[0], "audit": "".join(own[2]), "sha": own[1].hexdigest()}] if own else []
                own = [conv, hashlib.sha256(), [], False]
                if len(ready) > 1000:
                    yield pa.RecordBatch.from_pylist(ready, schema)
                    ready = []
            own[2].append(letters)
            for role, text, _ in lines:
                own[1].update((("\n" if own[3] else "") + f"{role}:{text}").encode())
                own[3] = True
        ready += [{"conv": own[0], "audit": "".join(own[2]), "sha": own[1].hexdigest()}] if own else []
        yield pa.RecordBatch.from_pylist(ready, schema)

    zero = F.lit(0).cast("long")
    letters = F.col("letters")
    classes = F.translate(letters, *_TO_CLASS)
    faults = {c: F.regexp_count(letters, F.lit(f"[{''.join(chr(97 + 4 * k + f) for k in range(4))}]")) for f, c in ((2, "blank"), (3, "duplicate"), (1, "truncated"))}
    legal = F.regexp_count(classes, F.lit("(?=su|ua|au)"))
    per_chunk = repair.chunks.join(repair.vectors, "head").select(
        "conv", "head", "start", "total", classes.alias("classes"), *[v.alias(k) for k, v in faults.items()], (F.length(letters) - 1 - legal).alias("illegal"))
    seams = repair.links.join(repair.chunks.select("head", F.col("conv"), F.substring(classes, -1, 1).alias("x")), "head").join(
        repair.chunks.select(F.col("head").alias("next"), F.substring(classes, 1, 1).alias("y")), "next").select(
        "conv", F.when(F.concat("x", "y").isin("su", "ua", "au"), 0).otherwise(1).alias("illegal"))
    found = per_chunk.groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
        (F.sum("total") + F.get(F.min_by("start", "head"), F.lit(_BEGIN))).alias("cost"))
    gaps = repair.rows.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    texts = repair.merged("conv").mapInArrow(digest, f"conv {kind}, audit string, sha string")
    parts = originals.select(F.col(conv_col).alias("conv")).distinct()
    for more in (found, seams, gaps, texts):
        parts = parts.unionByName(more, allowMissingColumns=True)
    return parts.groupBy("conv").agg(
        *[F.coalesce(F.sum(c).cast("long"), zero).alias(c) for c in _NUMBERS], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("sha"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")).withColumnRenamed("conv", conv_col)
