"""Word-level substring dedup with prefix-partitioned suffix trees.

The suffixes that can matter are the starts of open windows (``windows``), 35 words deep and more. Putting each into the
tree by its own first words would move 35 words for every single one, so the tree is a sparse one: its suffixes begin at the
4-word prefix that a window's key chooses, and the windows around it travel with it as one text. Texts are split into
groups by that prefix; a prefix that more texts share than fit a task's memory is lengthened, to the words that all
windows of a range of offsets share, until groups fit.

Each group's texts make one generalised suffix tree, held as its leaves in word order with the common-prefix depth of
neighbours, from which internal nodes are read. Nodes at least 35 words deep are repeats, and all their leaves start
repeated windows; a node whose leaves are preceded by different words is a maximal repeat.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfund.llm.common import attach, keyed, table
from quillfund.llm.windows import classify, in_groups, kept_pieces, secret_key, settle, spans, window_runs

LENGTH = 35
#: Words of the prefix that chooses a group.
GRAM = 4
#: Different texts of one group that a task takes; larger groups get longer prefixes.
GROUP_TEXTS = 8192
#: Bytes of text (8 a word) whose trees are built at once.
BATCH_BYTES = 4 << 20


class SuffixTree:
    """The suffixes of several texts that are at least ``length`` words long, as leaves of a tree of words.

    ``order``: the leaves' positions, sorted by their first ``length`` words; ``depth[k]``: words that the leaves k and
    k + 1 have in common (exact below twice the largest power of two within ``length``). No repeat holds a word that occurs
    once, so suffixes with one among their first ``length`` words are left out.
    """

    def __init__(self, words: np.ndarray, ends: np.ndarray, length: int):
        self.words, self.ends, self.length = words, ends, length
        self.room = ends - np.arange(len(words))
        _, code, count = np.unique(words, return_inverse=True, return_counts=True)
        once = np.concatenate([[0], np.cumsum(count[code] == 1)])
        reach = np.minimum(self.room, length)
        can = np.flatnonzero((self.room >= length) & (once[np.arange(len(words)) + reach] == once[:-1]))
        # ranks[j][i]: the place of the 2**j words at i among all such spans in word order, -1 past the end of a text.
        self.ranks = [code.astype(np.int64)]
        needed = np.bincount(can, minlength=len(words) + 1) - np.bincount(can + length, minlength=len(words) + 1)
        inside = np.flatnonzero(np.cumsum(needed[:-1]) > 0)  # only words of windows that may repeat are ranked further
        step = 1
        while 2 * step <= length:
            at, low = inside[self.room[inside] >= 2 * step], self.ranks[-1]
            at = at[low[at + step] >= 0]
            rank = np.full(len(words), -1, np.int64)
            rank[at] = np.unique(low[at] << 32 | low[at + step] + 1, return_inverse=True)[1]
            self.ranks.append(rank)
            step *= 2
        top = self.ranks[-1]
        self.order = can[np.lexsort((top[can + length - step], top[can]))]
        self.depth = self.common(self.order[:-1], self.order[1:])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at ``a`` and ``b`` have in common."""
        found = np.zeros(len(a), np.int64)
        for j in range(len(self.ranks) - 1, -1, -1):
            x, y = a + found, b + found
            able = np.flatnonzero((x < self.ends[a]) & (y < self.ends[b]))
            rank = self.ranks[j]
            same = able[(rank[x[able]] >= 0) & (rank[x[able]] == rank[y[able]])]
            found[same] += 1 << j
        return found

    def deep_nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The internal nodes of ``length`` words or more that have none such above them: first leaf, last leaf, depth, and
        whether different words (or none) precede the leaves, so that the repeat is maximal."""
        deep = np.concatenate([[False], self.depth >= self.length, [False]])
        first, last = np.flatnonzero(~deep[:-1] & deep[1:]), np.flatnonzero(deep[:-1] & ~deep[1:])
        depth = np.minimum.reduceat(np.append(self.depth, 0), np.stack([first, last], axis=1).ravel())[::2]
        starts = np.diff(self.ends, prepend=-1) != 0
        before = np.where(starts[self.order], -1 - self.order, self.ranks[0][self.order - 1])
        differ = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])]) if len(before) else before
        return first, last, depth, differ[last] > differ[first]


def repeated(words: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """The positions of several joined texts whose ``length`` words start at another position too: leaves of deep nodes."""
    tree = SuffixTree(words, ends, length)
    first, last, _, _ = tree.deep_nodes()
    again, edges = np.zeros(len(words), bool), np.zeros(len(tree.order) + 1, np.int64)
    edges[first] += 1
    edges[last + 1] -= 1
    again[tree.order[np.cumsum(edges[:-1]) > 0]] = True
    return again


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_texts: int = GROUP_TEXTS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The word spans of ``keyed`` documents that repeated ``length``-word sequences cover: doc_id, t, items of (begin, end)."""
    key = secret_key()
    whole, asked = classify(window_runs(docs, "word", length, gram, key))
    settled = settle(docs, asked, "word", length, gram, key, group_texts, in_groups(length, batch_bytes, 8, repeated))
    return spans(whole.unionByName(settled), length)


def remove_repeated_words(docs: DataFrame, length: int = LENGTH, **limits) -> DataFrame:
    """``doc_id, words, removed, kept``: each row's words, the maximal spans removed and the words left.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Every word covered by a window of ``length`` words whose sequence starts
    at another place too, same document included, goes; windows are judged on the input. A null text has no words; texts
    with fewer than ``length`` words keep all; of repeated rows each loses its text. An empty table gives an empty result;
    other columns are not read.
    """
    docs = keyed(docs)
    found = attach(docs, repeated_spans(docs, length, **limits), "items", 24)
    found = found.select("doc_id", "items", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"))
    pieces = kept_pieces("items", F.size("words"))
    kept = F.when(F.col("items").isNull(), F.col("words")).otherwise(F.flatten(F.transform(pieces, lambda p: F.slice("words", p["begin"] + 1, p["size"]))))
    none = F.array().cast("array<struct<begin:int,end:int>>")
    return found.select("doc_id", "words", F.coalesce("items", none).alias("removed"), kept.alias("kept"))


def op4_suffix_trees(spark, sf_dir: str) -> DataFrame:
    found = remove_repeated_words(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("words").cast("long").alias("n_words"), F.aggregate("removed", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["begin"]).alias("n_removed"), F.sha2(F.array_join("kept", " ").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
 g AS (SELECT s.r, s.i, array_to_string(d.w[s.i : s.i + 34], ' ') AS k FROM s JOIN d ON d.r = s.r),
 again AS (SELECT k FROM g GROUP BY k HAVING count(*) > 1),
 hit AS (SELECT r, unnest(range(i, i + 35)) AS p FROM g WHERE k IN (SELECT k FROM again)),
 gone AS (SELECT r, list(DISTINCT p) AS ps FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, p: NOT list_contains(ps, p)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone ON gone.r = d.r
"""
