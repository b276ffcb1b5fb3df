"""Chat formatting as a prefix tree: shared first turns are emitted once, depth first, with positions and attention intervals.

A node of the tree is a turn together with all turns before it, named by a chained digest. Tokens are code points of the formatted
turn. A run of nodes without a branch is a segment, named by its first node; a node's path is the list of segments down to its own.
Nodes are sorted by path and depth, which is a depth-first order, over ranges; a token's place in that order is its offset, its place
in its conversation is its position, and it may attend to its ancestors' tokens, given as intervals of offsets (one for each
segment), and to its own node up to itself. A long conversation that branches nowhere is one segment, so nothing grows with the square
of its turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import checkpoints as scratch

#: The template: fixed values.
OPEN, COLON, CLOSE = "### ", ": ", " </turn>\n"
LEARNED = "assistant"
_ID = 32
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ((?:[^\\:]++|\\(?:\\|###|</turn>|:))*+): ((?:[^\\<]++|\\(?:\\|###|</turn>)|<(?!/turn>))*+)</turn>\n")


def escape(text: str) -> str:
    """A backslash before each control string of the text, and before each backslash."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> str:
    return OPEN + escape(role).replace(":", "\\:") + COLON + escape(text) + CLOSE


def parse_turn(formatted: str) -> tuple[str, str, int, int]:
    """Role and text of one formatted turn, and the bounds of the escaped text."""
    m = _TURN.fullmatch(formatted)
    if not m or not m[2].endswith(" "):
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(m[2][:-1]), m.start(2), m.end(2) - 1


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[dict]]]:
    for batch in batches:
        yield batch, batch.to_pylist()


_WALK = "conv_id long, seq long, node string, parent string, role string, text string, position long"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def walk(turns: DataFrame) -> DataFrame:
    """The node of every turn. A conversation is read as a stream in order of turn (null first), role and text; null texts and roles
    are empty. Rows with a null conv_id are one conversation."""
    schema = _arrow(_WALK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: object = run
        seq = position = 0
        node = ""
        for _, rows in _stream(batches):
            out = []
            for r in rows:
                if r["conv_id"] != last or last is run:
                    last, seq, position, node = r["conv_id"], 0, 0, ""
                role, text = r["role"] or "", r["text"] or ""
                parent = node
                node = hashlib.sha256(f"{parent}\n{len(role)}\n{role}{text}".encode()).hexdigest()[:_ID]
                out.append(dict(zip(schema.names, (r["conv_id"], seq, node, parent, role, text, position), strict=True)))
                seq += 1
                position += len(format_turn(role, text))
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    own = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    order = ["conv_id", "turn", "role", "text"]
    return own.repartition("conv_id").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in order)).mapInArrow(run, _WALK)


def _segment_paths(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and path, the names of the segments from its root's to its own, put together."""
    branches = nodes.where("parent <> ''").groupBy("parent").agg(F.count("*").alias("n")).where("n > 1").select("parent", F.lit(True).alias("branch"))
    # roots are heads without a join, in which the empty parent would be one key for all conversations
    below = nodes.where("parent <> ''").select("node", "parent").join(scratch.broadcast_if_small(scratch.materialize(branches, "branches")), "parent", "left")
    roots = nodes.where("parent = ''").select("node", F.lit(True).alias("head"))
    heads = scratch.materialize(below.select("node", F.col("branch").isNotNull().alias("head")).unionByName(roots), "heads")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = ""
        for batch, rows in _stream(batches):
            out = []
            for r in rows:
                if r["seq"] == 0:
                    path = ""
                if r["head"]:
                    path += r["node"]
                out.append(path)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(out, pa.string())], names=["node", "path"])

    rows = members.join(heads, "node").select("conv_id", "seq", "node", "head")
    dealt = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "seq")
    return dealt.mapInArrow(run, "node string, path string").dropDuplicates(["node"])


_EMITTED = "node string, parent string, path string, seq long, part int, local long, size long, position long, formatted string, loss_from long, loss_to long"


def prefix_tree(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The emitted tree, and the members (conv_id, seq, node) of every conversation of turns (conv_id, turn, role, text).

    The tree has a row for each node: node, parent, depth, offset of its first token in depth-first order, position of that token in
    its conversation, formatted (its tokens), loss_from and loss_to (the bounds of the learned tokens in it, equal if
    there are none), and attend (its ancestors' tokens as [from, to) intervals of offsets, root first).

    Repeated rows are turns of their own. Texts of any length are kept whole. A conversation of any number of turns is walked as a
    stream by one task, as its digests follow one another; a path takes 32 characters for each segment on it. Other columns are
    ignored; an empty table gives an empty tree. The two results are tables in the shared folder, the only ones that stay there.
    """
    with scratch.scope() as stays:
        stays += _prefix_tree(turns)
    return stays[0], stays[1]


def _prefix_tree(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    walked = scratch.materialize(walk(turns), "walked")
    members = scratch.materialize(walked.select("conv_id", "seq", "node"), "members")
    nodes = scratch.materialize(walked.select("node", "parent", "seq", "role", "text", "position").dropDuplicates(["node"]), "nodes")
    schema = _arrow(_EMITTED)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, offset = TaskContext.get().partitionId(), 0
        for _, rows in _stream(batches):
            out = []
            for r in rows:
                formatted = format_turn(r["role"], r["text"])
                a = len(OPEN) + len(escape(r["role"]).replace(":", "\\:")) + len(COLON)
                b = len(formatted) - len(CLOSE) if r["role"] == LEARNED else a
                kept = {c: r[c] for c in ("node", "parent", "path", "seq", "position")}
                out.append(kept | {"part": part, "local": offset, "size": len(formatted), "formatted": formatted, "loss_from": a, "loss_to": b})
                offset += len(formatted)
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    located = scratch.materialize(nodes.join(_segment_paths(members, nodes), "node"), "located")
    ordered = located.repartitionByRange("path", "seq").sortWithinPartitions("path", "seq")
    emitted = scratch.materialize(ordered.mapInArrow(emit, _EMITTED), "emitted")
    scratch.discard(nodes, located)
    # one row for each partition: where its tokens begin
    base, ahead = {}, 0
    for r in emitted.groupBy("part").agg(F.sum("size").alias("size")).orderBy("part").collect():
        base[r["part"]] = ahead
        ahead += r["size"]
    bases = turns.sparkSession.createDataFrame(list(base.items()), "part int, base long")
    placed = emitted.join(F.broadcast(bases), "part").withColumn("offset", F.col("base") + F.col("local"))
    segments = scratch.materialize(placed.groupBy("path").agg(F.min("offset").alias("from"), F.max(F.col("offset") + F.col("size")).alias("to")), "segments")
    count = (F.length("path") / _ID).cast("int")
    above = segments.where(count > 1).select("path", F.explode(F.sequence(F.lit(1), count - 1)).alias("level"))
    above = above.select("path", "level", F.expr(f"substring(path, 1, level * {_ID})").alias("upper"))
    spans = segments.select(F.col("path").alias("upper"), F.struct("from", "to").alias("span"))
    lists = above.join(spans, "upper").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("level", "span"))).alias("a"))
    known = segments.join(lists, "path", "left").select("path", F.col("from").alias("begin"), F.transform("a", lambda x: x["span"]).alias("above"))
    kind = "array<struct<from:bigint,to:bigint>>"
    own = F.when(F.col("offset") > F.col("begin"), F.array(F.struct(F.col("begin").alias("from"), F.col("offset").alias("to"))))
    attend = F.concat(F.coalesce("above", F.array().cast(kind)), F.coalesce(own, F.array().cast(kind)))
    tree = placed.join(known, "path").select(
        "node", "parent", (F.col("seq") + 1).cast("int").alias("depth"), "offset", "position", "formatted", "loss_from", "loss_to", attend.alias("attend")
    )
    return scratch.materialize(tree, "tree"), members


def read_back(tree: DataFrame, members: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of every conversation, parsed from the tree.

    turns_sha256 is the digest of role, line end, text, line end for each turn; loss_sha256 that of all text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def closed() -> dict:
            return {"conv_id": state[0], "n_turns": state[1], "turns_sha256": state[2].hexdigest(), "loss_chars": state[3], "loss_sha256": state[4].hexdigest(), "formatted_chars": state[5]}

        for _, rows in _stream(batches):
            out = []
            for r in rows:
                if state is None or r["conv_id"] != state[0]:
                    if state is not None:
                        out.append(closed())
                    state = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, _, _ = parse_turn(r["formatted"])
                learned = unescape(r["formatted"][r["loss_from"] : r["loss_to"]])
                if r["position"] != state[5]:
                    raise ValueError("a turn's position differs from the tokens before it")
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(learned)
                state[4].update(learned.encode())
                state[5] += len(r["formatted"])
            yield pa.RecordBatch.from_pylist(out, schema=kind)
        if state is not None:
            yield pa.RecordBatch.from_pylist([closed()], schema=kind)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = pa.schema([(c, pa.string() if c.endswith("sha256") else pa.int64()) for c in names])
    rows = members.join(tree.select("node", "position", "formatted", "loss_from", "loss_to"), "node")
    dealt = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "seq")
    return dealt.select("conv_id", "position", "formatted", "loss_from", "loss_to").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
