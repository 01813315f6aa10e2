"""Chat formatting as prefix trees: conversations that share their first turns share their tokens.

A turn's node is a hash of its parent's node, its role and its text, so conversations that begin alike meet in the same
nodes. Sequences are packed from such trees: each node's text is written once, depth first, with the positions it has in
its conversations and the intervals of its ancestors, which are all that its tokens may attend to. A tree with many
conversations is cut below the nodes that more than ``together`` of them share. The subtrees under one such node fill
packs of up to ``together`` conversations, and the shared turns above are written once in each pack; conversations that
are alike to the end share one path, however many they are. Tokens are code points.
"""

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written

#: Conversations that one pack holds at most, unless they are all the same.
TOGETHER = 64
#: Rows and characters of whole packs that a group of the packing holds, about; conversations under one cut that are dealt
#: into packs in a row.
BIN, BIN_CHARS, IN_A_ROW = 2000, 2_000_000, 2048

# The template.
OPEN, COLON, CLOSE, OTHER = "### ", ": ", " </turn>\n", "@"
ROLES = {"user": "User", "assistant": "Assistant", "system": "System"}
_roles_back = {v: k for k, v in ROLES.items()}
_control = re.compile(r"\\|#{3,}|</turn>|:")
_escaped = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """A text with an escape character before itself, colons, runs of #, and end marks."""
    return _control.sub(lambda m: "".join("\\" + c for c in m[0]) if m[0][0] == "#" else "\\" + m[0], text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


def head(role: str) -> str:
    """What comes before a turn's text; roles without a name of their own are written escaped."""
    return OPEN + (ROLES[role] if role in ROLES else OTHER + escape(role)) + COLON


def segment(role: str, text: str) -> str:
    """A turn as the template writes it."""
    return head(role) + escape(text) + CLOSE


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        colon = formatted.index(COLON, at)  # an escaped colon that a space follows has its escape before the colon
        while formatted[colon - 1] == "\\":
            before = formatted[at:colon]
            if (len(before) - len(before.rstrip("\\"))) % 2 == 0:
                break
            colon = formatted.index(COLON, colon + 1)
        name = formatted[at + len(OPEN) : colon]
        end = formatted.index(CLOSE, colon + 1)
        role = unescape(name[len(OTHER) :]) if name.startswith(OTHER) else _roles_back[name]
        out.append((role, unescape(formatted[colon + len(COLON) : end])))
        at = end + len(CLOSE)
    return out


def _chained(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes of turns that come sorted by conversation; holds one row back to know a conversation's last."""
    names = ["conv_id", "idx", "parent", "node", "role", "text", "last"]
    before, idx, node, held = object(), 0, "", None
    for batch in rows:
        out = []
        for conv, role, text in zip(batch["conv_id"].tolist(), batch["role"].tolist(), batch["text"].tolist()):
            conv = None if conv is None or conv != conv else int(conv)
            same = conv == before and held is not None
            if held is not None:
                out.append((*held, not same))
            idx, parent = (idx + 1, node) if same else (1, "")
            node = hashlib.blake2b(f"{parent}|{len(role)}|{role}|{text}".encode(), digest_size=16).hexdigest()
            before, held = conv, (conv, idx, parent, node, role, text)
        yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
    if held is not None:
        yield pd.DataFrame([(*held, True)], columns=names).astype({"conv_id": "Int64"})


_SEGMENT = "pack string, ord int, node string, parent string, depth int, start long, length long, position long, intervals array<struct<start: long, end: long>>, loss struct<start: long, end: long>, text string, ends boolean"


def _packed(nodes: pd.DataFrame) -> pd.DataFrame:
    """The nodes of packs depth first, with offsets, positions and ancestors' intervals."""
    out: list[tuple] = []
    ordered = nodes.sort_values(["pack", "depth", "node"]).itertuples(index=False)
    for name, group in groupby(ordered, key=lambda r: r.pack):
        rows, children = list(group), {}
        for i, r in enumerate(rows):
            children.setdefault(r.parent, []).append(i)
        at, ord_ = 0, 0
        stack = [(i, 0, []) for i in reversed(children.get("", []))]
        while stack:
            i, position, above = stack.pop()
            r = rows[i]
            text = segment(r.role, r.text)
            start, end = at, at + len(text)
            own = [*above[:-1], (above[-1][0], end)] if above and above[-1][1] == start else [*above, (start, end)]
            said = start + len(head(r.role))
            loss = {"start": said, "end": end - len(CLOSE)} if r.role == "assistant" else None
            out.append((name, ord_, r.node, r.parent, r.depth, start, len(text), position, [{"start": a, "end": b} for a, b in own], loss, text, r.ends))
            at, ord_ = end, ord_ + 1
            stack += [(c, position + len(text), own) for c in reversed(children.get(r.node, []))]
    return pd.DataFrame(out, columns=["pack", "ord", "node", "parent", "depth", "start", "length", "position", "intervals", "loss", "text", "ends"])


def _by_bins(rows: DataFrame):
    """Rows grouped so that whole packs come together, about BIN rows and BIN_CHARS characters at a time at most."""
    n, chars = rows.agg(F.count("*"), F.sum(F.length("text"))).first()
    bins = max(1, n // BIN, (chars or 0) // BIN_CHARS)
    return rows.withColumn("bin", F.pmod(F.xxhash64("pack"), F.lit(bins))).groupBy("bin")


def _filled(together: int):
    """Packs of subtrees that come sorted by cut and bucket: each takes the next ones while it has room.

    The first pack of a cut's first bucket has the cut's name, and room for the conversations that end there.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, name, room = None, "", 0
        for rows in batches:
            names = []
            for cut, bucket, unit, convs in zip(rows["cut"].tolist(), rows["bucket"].tolist(), rows["unit"].tolist(), rows["convs"].tolist()):
                if (cut, bucket) != before and bucket == 0 and convs < together:
                    name, room = cut, together - 1
                elif (cut, bucket) != before or convs > room:
                    name, room = unit, together
                before, room = (cut, bucket), room - convs
                names.append(name)
            yield pd.DataFrame({"unit": rows["unit"], "pack": names})

    return of


def _in_packs(ways: DataFrame, together: int) -> DataFrame:
    """conv_id, pack, leaf and n_turns of conversations, whose ``first`` is their first node that not many share."""
    told = ways.select("conv_id", F.col("first.node").alias("unit"), F.col("first.parent").alias("cut"), F.col("end.node").alias("leaf"), F.col("end.idx").cast("long").alias("n_turns"))
    under = F.col("unit").isNotNull() & (F.col("cut") != "")
    units = written(told.where(under).groupBy("cut", "unit").agg(F.count("*").alias("convs")))
    totals = units.groupBy("cut").agg(F.sum("convs").alias("total"))
    dealt = units.join(totals.hint("merge"), "cut").withColumn("bucket", F.pmod(F.xxhash64("unit"), F.greatest(F.lit(1), F.expr(f"total div {IN_A_ROW}"))))
    keys = ["cut", "bucket"]
    packs = written(dealt.select(*keys, "unit", "convs").repartition(*keys).sortWithinPartitions(*keys, "unit").mapInPandas(_filled(together), "unit string, pack string"))
    names = ["conv_id", "pack", "leaf", "n_turns"]
    return told.where(under).join(packs.hint("merge"), "unit").select(*names).unionByName(told.where(~F.coalesce(under, F.lit(False))).withColumn("pack", F.coalesce("unit", "leaf")).select(*names))


def pack(conversations: DataFrame, together: int = TOGETHER) -> tuple[DataFrame, DataFrame]:
    """(segments, members): the packed sequences by segment, and each conversation's pack, last node and n_turns.

    A segment has its pack, place in depth-first order, node, parent, depth, start and length in the pack's text,
    position of its first token in its conversations, the intervals that it may attend to (its ancestors' and its own),
    the interval of its loss (an assistant's text), its text, and whether a conversation ends there.

    Turns go by ``turn``, nulls first, then by role and text where equal; null roles and texts are empty; repeated rows
    are turns of their own; a null conv_id is a conversation like another. No rows: none. Other columns are not read.
    A conversation's turns stream through one task, whatever their number, and are packed together.
    """
    empty = F.lit("")
    turns = conversations.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    chained = written(ordered.select("conv_id", "role", "text").mapInPandas(_chained, "conv_id long, idx int, parent string, node string, role string, text string, last boolean"))
    many = written(chained.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > together).select("node", "n", F.lit(True).alias("many")))
    # Nodes with many conversations come first on every path; the first one after them begins a subtree under a cut.
    paths = chained.select("conv_id", "idx", "parent", "node")
    # A first turn that all have is dealt over tasks.
    paths = spread_join(paths, many, "node", chained.count(), "conv_id", how="left") if many.limit(1).count() else paths.withColumn("many", F.lit(None).cast("boolean"))
    ways = written(paths.groupBy("conv_id").agg(F.min(F.when(F.col("many").isNull(), F.struct("idx", "node", "parent"))).alias("first"), F.max(F.struct("idx", "node")).alias("end")))
    members = written(_in_packs(ways, together))
    of = members.select(F.col("conv_id").alias("c"), "pack")
    nodes = written(
        chained.join(of.hint("merge"), F.col("conv_id").eqNullSafe(F.col("c")))
        .groupBy("pack", "node")
        .agg(F.first("parent").alias("parent"), F.first("idx").alias("depth"), F.first("role").alias("role"), F.first("text").alias("text"), F.max("last").alias("ends"))
    )
    return _by_bins(nodes).applyInPandas(_packed, _SEGMENT), members


def repeats(segments: DataFrame) -> DataFrame:
    """node, packs, repeated: nodes that several packs hold, and the characters that their text takes beyond the first."""
    return segments.groupBy("node").agg(F.count("*").alias("packs"), ((F.count("*") - 1) * F.max("length")).alias("repeated")).where("packs > 1")


_READ = "pack string, leaf string, turns array<struct<role: string, text: string>>, loss_text string, formatted_chars long"


def _read(segments: pd.DataFrame) -> pd.DataFrame:
    """The conversations of packs, read back from their texts by their last nodes' intervals and the loss mask."""
    out = []
    ordered = segments.sort_values(["pack", "ord"]).itertuples(index=False)
    for name, group in groupby(ordered, key=lambda r: r.pack):
        rows = list(group)
        whole = "".join(r.text for r in rows)
        losses = sorted((int(r.loss["start"]), int(r.loss["end"])) for r in rows if r.loss is not None)
        starts = [a for a, _ in losses]
        for r in rows:
            if r.ends:
                spans = [(int(x["start"]), int(x["end"])) for x in r.intervals]
                formatted = "".join(whole[a:b] for a, b in spans)
                inside = (losses[bisect_left(starts, x) : bisect_left(starts, y)] for x, y in spans)
                said = "".join(unescape(whole[a:b]) for some in inside for a, b in some)
                out.append((name, r.node, [{"role": a, "text": b} for a, b in parse(formatted)], said, len(formatted)))
    return pd.DataFrame(out, columns=["pack", "leaf", "turns", "loss_text", "formatted_chars"])


def read_back(segments: DataFrame) -> DataFrame:
    """pack, leaf, turns, loss_text and formatted_chars of every different conversation in packed segments."""
    return _by_bins(segments).applyInPandas(_read, _READ)


def digests(conversations: DataFrame, together: int = TOGETHER) -> DataFrame:
    """Per conversation, read back from the packed output: n_turns, turns_sha256, loss_chars, loss_sha256 and
    formatted_chars."""
    segments, members = pack(conversations, together)
    read = read_back(written(segments))
    told = F.concat(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""))
    # An end has its path as its name, but a pack above an end that many share may hold it too.
    each = written(read.select("pack", "leaf", F.sha2(told, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars", F.size("turns").cast("long").alias("n")))
    # So is a conversation that many repeat.
    path = F.concat_ws("\0", "pack", "leaf").alias("path")
    sizes = members.groupBy("pack", "leaf").agg(F.count("*").alias("n"))
    ends = written(each.withColumnRenamed("n", "n_turns").join(sizes.hint("merge"), ["pack", "leaf"]).select(path, "n", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"))
    return spread_join(members.select("conv_id", path), ends, "path", members.count(), "conv_id").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
