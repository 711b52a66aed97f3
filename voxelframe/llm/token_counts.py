"""Edit-aware token counts over kept segment trees of pre-tokens.

A document's tree has its pre-tokens at the leaves, each with its length in code
points and its token count, in blocks of at most MOST; every node has the sums
of its subtree: code points, tokens, pre-tokens. Places are relative to the
node, so an edit changes nothing beside its path. The trees are a table:
build_trees() makes it once, apply_edits() reads it and gives the trees after
the edits, which can be kept and edited again.

A pre-token depends on the text from its start to at most two characters past
its end. An edit therefore re-splits from the first pre-token that reaches its
start, and stops at the first new border past the edit that is an old border
too; only those pre-tokens are encoded again, only the blocks that hold them
are split or merged, and only the sums above them are renewed.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Stage
from .words import slices, text_buffer

#: Characters past its end that can decide a pre-token.
CONTEXT = 2
#: Children or leaves of a node: at most, and (beside the only ones of a level) at least.
MOST, LEAST = 128, 32
CACHE = 200_000
#: Bytes of text whose trees are in memory at once (or one longer text).
SLICE = 1 << 20
_held: dict[str, Counter] = {}


def default_ranks() -> str:
    """The public 50k byte-level vocabulary installed with the tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Counter:
    """Token counts of pre-tokens, remembered for a bounded number of them."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known, out = self.known, []
        for p in pieces:
            n = known.get(p)
            if n is None:
                n = len(self.encoding.encode_ordinary(p))
                if len(known) >= CACHE:
                    known.clear()
                if len(p) <= 64:
                    known[p] = n
            out.append(n)
        return out


def counter(path: str) -> Counter:
    if path not in _held:
        _held[path] = Counter(path)
    return _held[path]


class Node:
    """A block of leaves (lengths, counts), or a node over others (kids), with the sums of its subtree."""

    __slots__ = ("chars", "counts", "kids", "lengths", "size", "tokens")

    def __init__(self, kids=None, lengths=None, counts=None, sums=None):
        self.kids, self.lengths, self.counts = kids, lengths, counts
        if sums is not None:
            self.size, self.chars, self.tokens = sums
        elif kids is None:
            self.size, self.chars, self.tokens = len(lengths), sum(lengths), sum(counts)
        else:
            self.size, self.chars, self.tokens = (sum(getattr(k, name) for k in kids) for name in ("size", "chars", "tokens"))

    def width(self) -> int:
        return len(self.lengths if self.kids is None else self.kids)


def _cut(items: list) -> list[list]:
    """items in even parts of at most MOST."""
    parts = -(-len(items) // MOST)
    return [items[len(items) * k // parts : len(items) * (k + 1) // parts] for k in range(parts)]


def _blocks(lengths: list[int], counts: list[int]) -> list[Node]:
    return [Node(lengths=a, counts=b) for a, b in zip(_cut(lengths), _cut(counts), strict=True)]


def _over(kids: list[Node]) -> list[Node]:
    return [Node(kids=part) for part in _cut(kids)]


def _part(values, low: int = 0, high: int | None = None) -> list[int]:
    """A part of a block's lengths or counts as a list; stored blocks hold arrays until they change."""
    part = values[low:high]
    return part if isinstance(part, list) else part.tolist()


def _joined(a: Node, b: Node) -> list[Node]:
    """Two neighbours of a level as one or two nodes."""
    return _blocks(_part(a.lengths) + _part(b.lengths), _part(a.counts) + _part(b.counts)) if a.kids is None else _over(a.kids + b.kids)


def _spliced(node: Node, low: int, high: int, lengths: list[int], counts: list[int]) -> list[Node]:
    """The nodes in place of node once its leaves low to high (exclusive) have become the given ones."""
    if node.kids is None:
        return _blocks(_part(node.lengths, 0, low) + lengths + _part(node.lengths, high), _part(node.counts, 0, low) + counts + _part(node.counts, high))
    kids, at, k = node.kids, 0, 0
    while k < len(kids) - 1 and at + kids[k].size < low:
        at += kids[k].size
        k += 1
    first, base = k, at
    new, gone = [], kids[k].size
    new += _spliced(kids[k], low - base, min(high - base, gone), lengths, counts)
    at += gone
    k += 1
    while k < len(kids) and at + kids[k].size <= high:  # wholly replaced
        at += kids[k].size
        k += 1
    if k < len(kids) and at < high:
        new += _spliced(kids[k], 0, high - at, [], [])
        k += 1
    out = kids[:first] + new + kids[k:]
    m = max(first - 1, 0)
    while m < min(first + len(new) + 1, len(out)) and len(out) > 1:
        if out[m].width() < LEAST:
            left = max(m - 1, 0)
            out[left : left + 2] = _joined(out[left], out[left + 1])
            if out[left].width() >= LEAST:
                m = left + 1
        else:
            m += 1
    return _over(out)


class TokenTree:
    """Token counts of one text under edits."""

    def __init__(self, text: str, tokens: Counter, leaves: list[Node] | None = None):
        self.text, self.tokens, self.encoded = text, tokens, 0
        if leaves is None:
            pieces = tokens.pattern.findall(text)
            leaves = _blocks(list(map(len, pieces)), tokens.counts(pieces))
        self._grow(leaves)

    def _grow(self, nodes: list[Node]) -> None:
        while len(nodes) > 1:
            nodes = _over(nodes)
        self.root = nodes[0] if nodes else Node(lengths=[], counts=[])
        while self.root.kids is not None and len(self.root.kids) == 1:
            self.root = self.root.kids[0]

    @property
    def total(self) -> int:
        return self.root.tokens

    def leaves(self, node: Node | None = None) -> list[Node]:
        """The blocks of leaves in order."""
        node = node or self.root
        if node.kids is None:
            return [node] if node.size else []
        return [x for k in node.kids for x in self.leaves(k)]

    def count(self, first: int, last: int, node: Node | None = None) -> int:
        """Tokens of the pre-tokens first to last (exclusive), from subtree sums."""
        node = node or self.root
        if first <= 0 and last >= node.size:
            return node.tokens
        if first >= last or last <= 0 or first >= node.size:
            return 0
        if node.kids is None:
            return sum(_part(node.counts, max(first, 0), last))
        out, at = 0, 0
        for k in node.kids:
            if first < at + k.size and last > at:
                out += self.count(first - at, last - at, k)
            at += k.size
        return out

    def upto(self, place: int) -> tuple[int, int]:
        """How many pre-tokens end at or before place, and where the last of them ends."""
        node, n, at = self.root, 0, 0
        while node.kids is not None:
            for k in node.kids:  # noqa: B007
                if at + k.chars > place:
                    break
                n, at = n + k.size, at + k.chars
            else:
                return n, at
            node = k
        for x in _part(node.lengths):
            if at + x > place:
                break
            n, at = n + 1, at + x
        return n, at

    def edit(self, start: int, length: int, new: str) -> int:
        """Replace length characters from start by new; gives the number of pre-tokens encoded again.

        A place past the end is the end.
        """
        start = min(max(start, 0), len(self.text))
        stop = min(start + max(length, 0), len(self.text))
        shift = len(new) - (stop - start)
        self.text = self.text[:start] + new + self.text[stop:]
        low, at = self.upto(start - CONTEXT - 1)  # the first pre-token that reads past start
        fresh, high, edited = [], self.root.size, start + len(new)
        for m in self.tokens.pattern.finditer(self.text, at):
            fresh.append(m.group())
            if m.end() >= edited and m.end() - shift >= stop:
                n, border = self.upto(m.end() - shift)
                if border == m.end() - shift and n:
                    high = n
                    break
        self._grow(_spliced(self.root, low, max(high, low), list(map(len, fresh)), self.tokens.counts(fresh)))
        self.encoded += len(fresh)
        return len(fresh)


_TREE = "lengths array<int>, counts array<int>, blocks array<struct<size:int,chars:int,tokens:int>>, n_tokens long, n_pretokens long"
_BLOCK = pa.struct([("size", pa.int32()), ("chars", pa.int32()), ("tokens", pa.int32())])
EDITS = "array<struct<start:int,length:int,text:string>>"


def _stored(trees: list[TokenTree]) -> list[pa.Array]:
    """The columns of _TREE."""
    leaves = [t.leaves() for t in trees]
    ends = lambda sizes: pa.array(np.cumsum([0, *sizes]), pa.int32())
    flat = lambda name: pa.array(np.concatenate([np.zeros(0, np.int32), *(np.asarray(getattr(b, name), np.int32) for blocks in leaves for b in blocks)]))
    of = ends(t.root.size for t in trees)
    sums = [pa.array([getattr(b, name) for blocks in leaves for b in blocks], pa.int32()) for name in ("size", "chars", "tokens")]
    blocks = pa.ListArray.from_arrays(ends(map(len, leaves)), pa.StructArray.from_arrays(sums, fields=list(_BLOCK)))
    return [pa.ListArray.from_arrays(of, flat("lengths")), pa.ListArray.from_arrays(of, flat("counts")), blocks, pa.array([t.total for t in trees], pa.int64()), pa.array([t.root.size for t in trees], pa.int64())]


def _loaded(text: str, lengths: np.ndarray, counts: np.ndarray, blocks: list[dict], tokens: Counter) -> TokenTree:
    """A tree from its stored blocks and their sums; nothing is split or encoded."""
    at, leaves = 0, []
    for b in blocks:
        end = at + b["size"]
        leaves.append(Node(lengths=lengths[at:end], counts=counts[at:end], sums=(b["size"], b["chars"], b["tokens"])))
        at = end
    return TokenTree(text, tokens, leaves)


def build_trees(docs: DataFrame, path: str | None = None, text_col: str = "text", edits: Column | None = None) -> DataFrame:
    """(doc_id, text, edits, lengths, counts, blocks, n_tokens, n_pretokens) for every row of docs.

    lengths and counts are those of the leaves in order, blocks the sums of the
    lowest nodes. edits (a column of docs, none by default) is only carried
    along. A null text counts as empty and has no leaves. Other columns are
    ignored.
    """
    path, kind = path or default_ranks(), dict(docs.dtypes)["doc_id"]

    def run(batches):
        tokens = counter(path)
        for batch in batches:
            for i, j in slices(text_buffer(batch.column(1))[1], SLICE):
                part = batch.slice(i, j - i)
                trees = [TokenTree(t, tokens) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, *_stored(trees)], ["doc_id", "text", "edits", "lengths", "counts", "blocks", "n_tokens", "n_pretokens"])

    rows = docs.select("doc_id", F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), (F.lit(None) if edits is None else edits).cast(EDITS).alias("edits"))
    return rows.mapInArrow(run, f"doc_id {kind}, text string, edits {EDITS}, {_TREE}")


def apply_edits(trees: DataFrame, edits: Column | None = None, path: str | None = None, keep_trees: bool = True) -> DataFrame:
    """The trees after the edits, with n_edits, n_reencoded, n_tokens_before and n_pretokens_before, for every row of trees.

    edits: a column of EDITS over trees (the carried ones by default), applied in order, places in code
    points of the text as it then is; a null array, a null edit and null fields
    (0, 0, '') change nothing. Only pre-tokens that an edit touches are split
    and encoded; all others are read from the table. Without keep_trees the
    result has no text, lengths, counts and blocks.
    """
    path, kind = path or default_ranks(), dict(trees.dtypes)["doc_id"]
    numbers = ["n_edits", "n_reencoded", "n_tokens_before", "n_pretokens_before"]

    def run(batches):
        tokens = counter(path)
        for batch in batches:
            for i, j in slices(text_buffer(batch.column(1))[1], SLICE):
                part = batch.slice(i, j - i)
                ids, texts, lengths, counts, blocks, n_tokens, n_pretokens, todo = part.columns
                held = []
                for k, (text, sums, changes) in enumerate(zip(texts.to_pylist(), blocks.to_pylist(), todo.to_pylist(), strict=True)):
                    tree = _loaded(text, lengths[k].values.to_numpy(), counts[k].values.to_numpy(), sums, tokens)
                    for e in changes or []:
                        if e is not None:
                            tree.edit(e["start"] or 0, e["length"] or 0, e["text"] or "")
                    held.append(tree)
                stored = _stored(held) if keep_trees else [pa.array([t.total for t in held], pa.int64()), pa.array([t.root.size for t in held], pa.int64())]
                more = [pa.array([len(x or []) for x in todo.to_pylist()], pa.int64()), pa.array([t.encoded for t in held], pa.int64()), n_tokens, n_pretokens]
                yield pa.RecordBatch.from_arrays([ids, *([pa.array([t.text for t in held], pa.string())] if keep_trees else []), *stored, *more], names)

    edits = F.col("edits") if edits is None else edits
    schema = f"doc_id {kind}, " + (f"text string, {_TREE}, " if keep_trees else "n_tokens long, n_pretokens long, ") + ", ".join(f"{n} long" for n in numbers)
    names = ["doc_id", *(["text", "lengths", "counts", "blocks"] if keep_trees else []), "n_tokens", "n_pretokens", *numbers]
    return trees.select("doc_id", "text", "lengths", "counts", "blocks", "n_tokens", "n_pretokens", edits.cast(EDITS).alias("edits")).mapInArrow(run, schema)


def count_with_edits(docs: DataFrame, edits: Column | None = None, path: str | None = None, text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_tokens, n_pretokens, n_edits, n_tokens_after, n_pretokens_after, n_reencoded[, text_after]) for every row of docs.

    Builds the trees, keeps them as a table, and applies edits (a column of
    docs, see apply_edits) to that table. A null text counts as empty. Other
    columns are ignored.
    """
    trees = Stage(docs.sparkSession, "tokens").put(build_trees(docs, path, text_col, edits), "trees")
    out = apply_edits(trees, path=path, keep_trees=with_text)
    before = [F.col("n_tokens_before").alias("n_tokens"), F.col("n_pretokens_before").alias("n_pretokens")]
    after = [F.col("n_tokens").alias("n_tokens_after"), F.col("n_pretokens").alias("n_pretokens_after")]
    return out.select("doc_id", *before, "n_edits", *after, "n_reencoded", *([F.col("text").alias("text_after")] if with_text else []))


def revision(text: Column) -> Column:
    """A fixed revision of a text: an insertion, a deletion and a replacement at its quarters."""
    n = F.coalesce(F.length(text), F.lit(0))
    at = lambda q: F.floor(n * q / 4).cast("int")
    edit = lambda start, length, new: F.struct(start.alias("start"), F.lit(length).alias("length"), F.lit(new).alias("text"))
    return F.array(edit(at(1), 0, " inserted words"), edit(at(2), 12, ""), edit(at(3), 5, "ed 2024's"))
