"""Conversation structure repair: the cheapest edits after which the role initials read ``(s?(ua)+)?``.

A conversation's rows become a signature of one letter a row: ``x`` for a row
that must go (blank or duplicate), else the role's initial (``s``, ``u``,
``a``; ``o`` for any other), in upper case if the text is truncated.  The
distinct signatures are sorted, so that a task walks them as a prefix trie: the
layers of the shared prefix stay on a stack, each new letter adds one layer,
and the answer is read off where a signature ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarrystone.llm.common import SPACES
from quarrystone.operators.tables import cut_lineage, join_hot, reduce_rows

#: Costs of the edits; a truncated row that stays adds LATE.
REROLE, DELETE, INSERT, LATE = 2, 3, 2, 1
#: The role that must come after each state: nothing yet, or the last role's initial.
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}
#: Where inserted turns lead from each state; more of them would come back to a state at a higher cost.
INSERTS = {state: [(state, ""), *[(at, "I" * k) for k, at in enumerate(path, 1)]] for state, path in {"": "ua", "s": "ua", "u": "a", "a": "u"}.items()}
#: From any state another one's future costs at most so much more, so a state further behind is never on a cheapest way.
SLACK = 5

#: States in the order of their edit strings, each with its cost above the cheapest.
Layer = tuple[tuple[str, int], ...]
BEGIN: Layer = (("", 0),)


@cache
def advance(layer: Layer, letter: str) -> tuple[Layer, int, tuple[tuple[int, str], ...]]:
    """The layer after a row, what the cheapest state's cost rose by, and for each state (place of the state before, edits since).

    Each state keeps its cheapest edit string, of equal costs the least.  A
    layer's strings end with a row's edit and have as many of those, so none
    begins another one: their order decides, and then the edits since.
    Costs are relative, so few layers exist and each step is computed once.
    """
    best: dict[str, tuple[int, int, str]] = {}
    late, role = (LATE if letter.isupper() else 0), letter.lower()
    for place, (state, cost) in enumerate(layer):
        for at, put in INSERTS[state]:
            ways = [("D", at, DELETE)]
            if role != "x":
                ways.append(("R", NEXT[at], REROLE + late))
                if role == NEXT[at] or (role == "s" and at == ""):
                    ways.append(("K", role, late))
            for edit, to, price in ways:
                found = (cost + INSERT * len(put) + price, place, put + edit)
                best[to] = min(best.get(to, found), found)
    base = min(cost for cost, _, _ in best.values())
    kept = sorted((place, edits, state, cost - base) for state, (cost, place, edits) in best.items() if cost - base <= SLACK)
    return tuple((state, cost) for _, _, state, cost in kept), base, tuple((place, edits) for place, edits, _, _ in kept)


def answers(signatures: Iterable[str]) -> Iterator[tuple[int, str]]:
    """(cost, edits) of each of the sorted signatures; layers of a prefix that a signature shares with the one before are kept."""
    layers, costs, steps = [BEGIN], [0], []
    last = ""
    for signature in signatures:
        shared = next((i for i, (a, b) in enumerate(zip(signature, last)) if a != b), min(len(signature), len(last)))
        del layers[shared + 1 :], costs[shared + 1 :], steps[shared:]
        for letter in signature[shared:]:
            layer, more, step = advance(layers[-1], letter)
            layers.append(layer)
            costs.append(costs[-1] + more)
            steps.append(step)
        last = signature
        ends = [(cost + INSERT * len(put), place, put) for place, (state, cost) in enumerate(layers[-1]) for at, put in INSERTS[state] if at in ("", "a")]
        cost, place, put = min(ends)
        edits = [put]
        for step in reversed(steps):
            place, put = step[place]
            edits.append(put)
        yield costs[-1] + cost, "".join(reversed(edits))


def _stream(schema: str, begin: Callable[[], Iterator], most_rows: int = 2048, most_chars: int = 4 << 20):
    """A function for mapInArrow that sends each row's dict to the generator ``begin()`` and writes the tuples it gives back, few at a time."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

        machine = begin()
        next(machine)
        for row in (dict(zip(part.schema.names, values)) for part in batches for values in zip(*[c.to_pylist() if c.nbytes < 1 << 24 else (v.as_py() for v in c) for c in part.columns])):
            for made in machine.send(row):
                out.append(made)
                chars += sum(len(v) for v in made if isinstance(v, str))
                if len(out) >= most_rows or chars >= most_chars:
                    yield flush()
                    out, chars = [], 0
        out += machine.send(None)
        if out:
            yield flush()

    return run


def _named(role: Column, text: Column) -> Column:
    """A digest of role and text together."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def _plain(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, named), null roles and texts as one space."""
    some = lambda c: F.coalesce(F.col(c), F.lit(" "))
    flat = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), some(role).alias("role"), some(text).alias("text"))
    return flat.withColumn("named", _named(F.col("role"), F.col("text")))


def find_faults(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, signature) of each conversation with rows.

    Rows are taken by turn, nulls first, and rows of one turn by role and a
    digest of the text; so equal rows are neighbours.  A row counts under its
    first fault: blank, duplicate (role and text seen earlier), truncated (its
    last character that is no space is none of ``.!?``).  ``illegal`` counts
    neighbours whose initials are not su, ua or au, ``gaps`` the turns missing
    between the least and the greatest.  Only digests go through the shuffle; a
    conversation streams through one task, which holds its signature.
    """
    spaces = SPACES.replace("\\", "\\\\")
    flat = _plain(rows, conv, turn, role, text).withColumn("end", F.rtrim(F.col("text"), F.lit(spaces)))
    end = F.right(F.col("end"), F.lit(1))
    narrow = flat.select("conv", "turn", "named", F.col("role").alias("sort"), F.substring("role", 1, 1).alias("initial"), F.when(end == "", "b").when(~end.isin(*".!?"), "t").otherwise("f").alias("fault"))
    first = F.row_number().over(Window.partitionBy("conv", "named").orderBy("turn")) == 1
    marked = narrow.withColumn("fault", F.when((F.col("fault") != "b") & ~first, "d").otherwise(F.col("fault")))
    kinds = dict(flat.dtypes)

    def machine() -> Iterator:
        open_, name = False, None
        turns: list = [None, None, 0]
        counts, illegal, signature, before = {}, 0, bytearray(), None

        def done() -> list[tuple]:
            if not open_:
                return []
            low, high, seen = turns
            gaps = 0 if low is None else high - low + 1 - seen
            return [(name, gaps, counts["b"], counts["d"], counts["t"], illegal, signature.decode())]

        out: list[tuple] = []
        while (row := (yield out)) is not None:
            out = []
            if not open_ or row["conv"] != name:
                out = done()
                open_, name, turns, counts, illegal, signature, before = True, row["conv"], [None, None, 0], dict.fromkeys("bdtf", 0), 0, bytearray(), None
            if row["turn"] is not None and row["turn"] != turns[1]:
                turns = [row["turn"] if turns[0] is None else turns[0], row["turn"], turns[2] + 1]
            counts[row["fault"]] += 1
            illegal += before is not None and before + row["initial"] not in ("su", "ua", "au")
            before = row["initial"]
            letter = "x" if row["fault"] in "bd" else before if before in ("s", "u", "a") else "o"
            signature += (letter.upper() if row["fault"] == "t" else letter).encode()
        yield done()

    dealt = marked.repartition(reduce_rows(rows.sparkSession), "conv").sortWithinPartitions("conv", "turn", "sort", "named")
    schema = f"conv {kinds['conv']}, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"
    return dealt.select("conv", "turn", "initial", "fault").mapInArrow(_stream(schema, machine), schema).withColumnRenamed("conv", conv)


def cheapest_edits(faults: DataFrame, signature: str = "signature") -> DataFrame:
    """The rows of ``faults`` with their ``cost`` and ``audit``, the initials of the cheapest edits (Delete, Insert, Keep, Rerole), of equal costs the least.

    Each signature is solved once, wherever and however often it comes; ranges
    of sorted signatures are the tasks, and a task holds one path of the trie.
    """
    faults = cut_lineage(faults)
    counted = faults.groupBy(signature).agg(F.count("*").alias("same"))
    dealt = counted.repartitionByRange(reduce_rows(faults.sparkSession), signature).sortWithinPartitions(signature)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def letters() -> Iterator[str]:
            for part in batches:
                waiting.append(part)
                yield from (v.as_py() for v in part.column(0))

        solved = answers(letters())
        while (first := next(solved, None)) is not None:
            part = waiting.pop()
            for at in range(0, part.num_rows, 512):
                piece = part.slice(at, 512)
                got = [first] if not at else []
                got += [next(solved) for _ in range(piece.num_rows - len(got))]
                cost, audit = zip(*got)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(cost, pa.int64()), pa.array(audit, pa.string())], [*piece.schema.names, "cost", "audit"])

    solved = cut_lineage(dealt.mapInArrow(run, f"{signature} string, same long, cost long, audit string"))
    total = solved.agg(F.coalesce(F.sum("same"), F.lit(0))).first()[0]
    return join_hot(faults, solved, [signature], "same", total)


def apply_edits(rows: DataFrame, audits: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, position, edit, role, text) of each repaired turn: rows kept, with a new role, or inserted with an empty text.

    ``audits`` has (conv, audit) once for each conversation.  The rows of a
    conversation come out next to each other and in order.
    """
    flat = _plain(rows, conv, turn, role, text).withColumn("audit", F.lit(None).cast("string"))
    heads = audits.select(F.col(conv).alias("conv"), "audit")
    both = flat.unionByName(heads, allowMissingColumns=True).withColumn("is_row", F.col("audit").isNull())
    kinds = dict(flat.dtypes)

    def machine() -> Iterator:
        name, audit, at, position, state = None, "", 0, 0, ""

        def inserts() -> Iterator[tuple]:
            nonlocal at, position, state
            while at < len(audit) and audit[at] == "I":
                state = NEXT[state]
                yield name, position, "I", ROLES[state], ""
                at, position = at + 1, position + 1

        out: list[tuple] = []
        while (row := (yield out)) is not None:
            if row["audit"] is not None:
                out = list(inserts())
                name, audit, at, position, state = row["conv"], row["audit"], 0, 0, ""
                continue
            out = list(inserts())
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            if edit == "R":
                state = NEXT[state]
            else:
                state = row["role"][:1]
            out.append((name, position, edit, ROLES[state] if edit == "R" else row["role"], row["text"]))
            position += 1
        yield list(inserts())

    dealt = both.repartition(reduce_rows(rows.sparkSession), "conv").sortWithinPartitions("conv", "is_row", "turn", "role", "named")
    schema = f"conv {kinds['conv']}, position long, edit string, role string, text string"
    return dealt.select("conv", "audit", "role", "text").mapInArrow(_stream(schema, machine), schema).withColumnRenamed("conv", conv)


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """What is wrong with each conversation and its cheapest edits, and the repaired turns.

    The first has (conv, gaps, blank, duplicate, truncated, illegal, cost,
    audit), the second what ``apply_edits`` gives.  A null conversation id is
    an id like any other, null roles and texts are one space, and a text of
    spaces is blank.  Texts of any length are taken whole; rows of one turn are
    ordered by role and digest, and repeated rows are duplicates.  Other
    columns are passed over, and an empty table gives empty results.
    """
    solved = cut_lineage(cheapest_edits(find_faults(rows, conv, turn, role, text)).drop("signature"))
    return solved, apply_edits(rows, solved, conv, turn, role, text)


def turn_digests(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, repaired_sha256) of conversations whose turns lie next to each other, as ``apply_edits`` leaves them: ``role:text``, joined by newlines."""
    kinds = dict(turns.dtypes)

    def machine() -> Iterator:
        digest, name, out = None, None, []
        while (row := (yield out)) is not None:
            out = []
            if digest is None or row["conv"] != name:
                out = [] if digest is None else [(name, digest.hexdigest())]
                digest, name, line = hashlib.sha256(), row["conv"], ""
            else:
                line = "\n"
            digest.update(f"{line}{row['role']}:{row['text']}".encode())
        yield [] if digest is None else [(name, digest.hexdigest())]

    schema = f"conv {kinds[conv]}, repaired_sha256 string"
    return turns.select(F.col(conv).alias("conv"), "role", "text").mapInArrow(_stream(schema, machine), schema).withColumnRenamed("conv", conv)


def damage_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) with one row in four damaged, by crc32 of ``conv:turn`` modulo 20; nulls count as one space.

    0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it,
    4 makes it the user's.
    """
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(some(conv), F.lit(":"), some(turn)).cast("binary")) % 20
    flat = rows.select(F.col(conv), F.col(turn), some(role).alias(role), some(text).alias(text), fate.alias("fate")).where("fate <> 0")
    new_text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate(text, ".!?", "")).otherwise(F.col(text))
    copies = F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1))
    made = flat.select(conv, turn, F.when(F.col("fate") == 4, "user").otherwise(F.col(role)).alias(role), new_text.alias(text), F.explode(copies).alias("copy"))
    return made.drop("copy")
