"""Edit-aware token counts.

A document is kept as a segment tree: its leaves are stretches of some pre-tokens, its inner nodes hold sums of characters and
tokens. An edit finds the leaves it touches by descending along the sums of characters, re-encodes only those, and puts the
new sums on the way up. A leaf that has grown too long is parted in its place.

Leaves part where one class of characters (letters, numbers, marks, white space) follows another, as pre-tokens do. Texts without
such places, as of one long word, part between two tokens of a pre-token. Where an edit leaves a border that tokens may
cross, the neighbour is the context that is encoded along with it. Inside a pre-token the two tokens that meet decide that. A pre-token
in which an edit changes all later tokens (one letter repeated) is encoded to its end, since its count needs them.

Edits of a document apply in the order of `seq`, each to the text that those before have left; positions count characters
and are cut to the text. Edits with equal `seq` apply by position, then removed, then inserted. Null and empty texts count 0
tokens and can be edited. Edits with a null field change nothing. Repeated rows are counted alike. A null doc_id has no
edits. Empty tables give no rows. A text is held by one task at a time, whole, however long. A column `edits` that documents
bring is replaced by with_edits; all their other columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category, ucd_3_2_0

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import parts_of
from .pretokens import ChunkIds, chunk_ids, encode

#: Characters of a new leaf, about, and how much further a better border is looked for.
LEAF, FURTHER = 512, 64
EDITS = "array<struct<seq: long, position: long, removed: long, inserted: string>>"
#: White space that Python and the tokenizer both know.
BLANKS = " \t\n\r\x0b\x0c"
#: A leaf: its text, number of tokens, first and last token.
Leaf = tuple[str, int, int, int]


@lru_cache(1 << 14)
def kind(c: str) -> str:
    """L, N, W (white space) or P (others); empty where it depends on the version of Unicode."""
    if c in BLANKS:
        return "W"
    old, new = (k if k in "LN" else "P" for k in (ucd_3_2_0.category(c)[0], category(c)[0]))
    unsure = c.isspace() or ucd_3_2_0.category(c) == "Cn" or "Z" in (ucd_3_2_0.category(c)[0], category(c)[0])
    return "" if unsure or old != new else new


def border(left: str, right: str, added: dict[str, bytes]) -> str:
    """What parts two stretches of text: "firm" (no token crosses), "soft" (inside a pre-token, the tokens that meet decide) or "none"."""
    if not left[-1].isspace() and right[0] in BLANKS:
        return "firm"
    if min(len(left), len(right)) < max(map(len, added), default=0) + 2:
        return "none"  # too short to tell an added token or a contraction
    if any(left.endswith(t[:i]) and right.startswith(t[i:]) for t in added for i in range(1, len(t))):
        return "none"
    a, b = kind(left[-1]), kind(right[0])
    if b == "L" and "'" in left[-2:] or a == "P" and right[0] == "'":
        return "none"  # a contraction, or a mark that would begin one
    if not a or not b or a == "W" and not (b == "W" and kind(right[1]) == "W"):
        return "none"  # the last white space of a run goes with what follows
    return "soft" if a == b else "firm"


class TokenTree:
    """The tree of one document: nodes are numbers, 1 the root; leaves are also a list, in which 0 is before the first and after the last."""

    def __init__(self, text: str, known: ChunkIds):
        self.known, self.encoded = known, 0
        self.start(self.parted(text, self.ids(text)))

    def start(self, leaves: list[Leaf]) -> None:
        self.chars, self.tokens, self.up, self.below, self.leaf, self.before, self.after = ([d, d] for d in (0, 0, 0, None, None, 0, 0))
        self.before[0] = self.after[0] = 1
        self.plant(1, leaves)

    @property
    def texts(self) -> list[str]:
        return [text for text, *_ in self.in_order()]

    def in_order(self) -> Iterator[Leaf]:
        at = self.after[0]
        while at:
            yield self.leaf[at]
            at = self.after[at]

    def ids(self, text: str) -> np.ndarray:
        self.encoded += len(text)
        return np.frombuffer(encode(text, self.known), "<u4")

    def parted(self, text: str, ids: np.ndarray) -> list[Leaf]:
        """Leaves of a text, from its ids."""
        cuts = [(0, 0)]
        if len(text) > 2 * LEAF:
            begins = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
            ends = np.cumsum(self.known.sizes[ids])[:-1]
            whole = np.flatnonzero(begins[ends])  # token borders that are borders of characters
            places = (np.cumsum(begins) - 1)[ends[whole]]
            while len(text) - cuts[-1][0] > 2 * LEAF:
                found, i = None, int(np.searchsorted(places, cuts[-1][0] + LEAF))
                while i < len(places) and (found is None or places[i] < cuts[-1][0] + LEAF + FURTHER):
                    c = int(places[i])
                    how = border(text[c - LEAF : c], text[c : c + LEAF], self.known.added)
                    if how == "firm" or how == "soft" and found is None:
                        found = c, int(whole[i]) + 1
                    if how == "firm":
                        break
                    i += 1
                if found is None:
                    break
                cuts.append(found)
        cuts.append((len(text), len(ids)))
        return [(text[a:b], t - s, int(ids[s]) if t > s else -1, int(ids[t - 1]) if t > s else -1) for (a, s), (b, t) in zip(cuts, cuts[1:])]

    def plant(self, node: int, leaves: list[Leaf]) -> None:
        """Leaves in place of the leaf `node`, and the sums above them."""
        chars, tokens, before, after = -self.chars[node], -self.tokens[node], self.before[node], self.after[node]
        new: list[int] = []
        self.under(node, leaves, new)
        for a, b in zip([before, *new], [*new, after]):
            self.after[a], self.before[b] = b, a
        self.add(self.up[node], chars + self.chars[node], tokens + self.tokens[node])

    def under(self, node: int, leaves: list[Leaf], new: list[int]) -> None:
        self.chars[node], self.tokens[node] = sum(len(x[0]) for x in leaves), sum(x[1] for x in leaves)
        if len(leaves) == 1:
            self.leaf[node] = leaves[0]
            new.append(node)
            return
        self.leaf[node], self.below[node] = None, (len(self.up), len(self.up) + 1)
        for of, default in ((self.chars, 0), (self.tokens, 0), (self.up, node), (self.below, None), (self.leaf, None), (self.before, 0), (self.after, 0)):
            of += default, default
        for child, half in zip(self.below[node], (leaves[: len(leaves) // 2], leaves[len(leaves) // 2 :])):
            self.under(child, half, new)

    def add(self, node: int, chars: int, tokens: int) -> None:
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node = self.up[node]

    def drop(self, leaf: int) -> None:
        before, after = self.before[leaf], self.after[leaf]
        self.after[before], self.before[after] = after, before
        self.add(leaf, -self.chars[leaf], -self.tokens[leaf])
        self.leaf[leaf] = None

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one that holds any at the end of the text), and the place in it."""
        node = 1
        while self.below[node]:
            left, right = self.below[node]
            if position >= self.chars[left] and self.chars[right] or not self.chars[left]:
                position -= self.chars[left]
                node = right
            else:
                node = left
        return node, position

    def depth(self, node: int) -> int:
        steps = 0
        while node := self.up[node]:
            steps += 1
        return steps

    def edit(self, position: int, removed: int, inserted: str) -> None:
        if not self.chars[1]:
            self.start([("", 0, -1, -1)])
        position = min(max(position, 0), self.chars[1])
        end = min(position + max(removed, 0), self.chars[1])
        (first, a), (last, b) = self.find(position), self.find(max(position, end - 1))
        b = b + 1 if end > position else a
        text = self.leaf[first][0][:a] + inserted + self.leaf[last][0][b:]
        beyond = self.after[last]
        while self.after[first] != beyond:
            self.drop(self.after[first])
        takes = 1
        while True:  # boundary context; more at a time the further it reaches, so that all of it is encoded twice at most
            left, right, added = self.before[first], self.after[first], self.known.added
            before = not left or text and border(self.leaf[left][0], text, added)
            behind = not right or text and border(text, self.leaf[right][0], added)
            near, far = bool(left) and before in ("", "none"), bool(right) and behind in ("", "none")
            if not near and not far:
                ids = self.ids(text)
                near = before == "soft" and not self.known.meet(self.leaf[left][3], int(ids[0]))
                far = behind == "soft" and not self.known.meet(int(ids[-1]), self.leaf[right][2])
                if not near and not far:
                    break
            for _ in range(takes):
                if near and (left := self.before[first]):
                    text = self.leaf[left][0] + text
                    self.drop(left)
                if far and (right := self.after[first]):
                    text += self.leaf[right][0]
                    self.drop(right)
            takes *= 2
        self.plant(first, self.parted(text, ids))
        leaves = len(self.up) // 2
        if self.depth(first) > 2 * leaves.bit_length() + 8 or leaves > 64 and leaves > 2 * sum(1 for _ in self.in_order()):
            self.start(list(self.in_order()))  # the same leaves, level again; nothing is encoded


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs and a column `edits`: those of edits (doc_id, seq, position, removed, inserted) that name the document, in order."""
    key = "_" * (1 + max(map(len, docs.columns))) + "of"
    fields = F.struct(*[F.col(n).cast(t).alias(n) for n, t in (("seq", "long"), ("position", "long"), ("removed", "long"), ("inserted", "string"))])
    of = edits.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias(key)).agg(F.array_sort(F.collect_list(fields)).alias("edits"))
    return docs.drop("edits").withColumn(key, F.col("doc_id").cast("long")).join(of, key, "left").drop(key)


def count_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_edits, tokens_before, tokens_after, chars_after, chars_reencoded of documents (doc_id, text, edits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chunk_ids(tokenizer_path)
        for b in (part for whole in batches for part in parts_of(whole)):
            rows = []
            for doc_id, text, edits in zip(b["doc_id"].to_pylist(), b["text"], b["edits"]):
                tree = TokenTree(text.as_py() or "", known)
                before, tree.encoded = int(tree.tokens[1]), 0
                edits = [e for e in edits.as_py() or () if None not in e.values()]
                for e in edits:
                    tree.edit(e["position"], e["removed"], e["inserted"])
                rows.append((doc_id, len(edits), before, int(tree.tokens[1]), int(tree.chars[1]), tree.encoded))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 6, names=NAMES)

    NAMES = ["doc_id", "n_edits", "tokens_before", "tokens_after", "chars_after", "chars_reencoded"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("edits").cast(EDITS).alias("edits")).mapInArrow(run, ", ".join(f"{n} long" for n in NAMES))
