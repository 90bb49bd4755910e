"""Token counts by a linear longest-match automaton.

Greedy longest-match word pieces, counted without building any piece: the vocabulary's trie has, at every node,
a failure link and the number of pieces that following it pops off, so a word costs a step a byte.  Words are
runs of anything but ASCII white space; a word is matched as a space followed by its bytes, so that the
vocabulary's entries with a leading space start words and the others continue them.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import cache

from pyspark.sql import DataFrame

from .common import out_schema, put

#: Distinct words that a worker remembers at most; then it forgets all of them, which changes no count.
REMEMBER = 400_000


class PieceCounter:
    """``count(word_bytes)``: the number of pieces of greedy longest match, -1 where some byte starts no entry."""

    def __init__(self, vocabulary: Iterable[bytes]):
        step: dict[int, int] = {}
        word_end = bytearray(1)
        parent, byte, order = [0], [0], [0]
        for entry in sorted({e for e in vocabulary if e}, key=len):
            at = 0
            for b in entry:
                to = step.get(at << 8 | b)
                if to is None:
                    to = len(parent)
                    step[at << 8 | b] = to
                    parent.append(at)
                    byte.append(b)
                    order.append(order[at] + 1)
                    word_end.append(0)
                at = to
            word_end[at] = 1
        fail, pops = [-1] * len(parent), [0] * len(parent)
        for node in sorted(range(1, len(parent)), key=order.__getitem__):
            if word_end[node]:
                fail[node], pops[node] = 0, 1  # the node's own string is the piece
                continue
            at, popped = parent[node], 0
            while True:  # pop pieces off the parent's string until its rest can take this node's byte
                popped += pops[at]
                at = fail[at]
                if at < 0:
                    break
                to = step.get(at << 8 | byte[node])
                if to is not None:
                    fail[node], pops[node] = to, popped
                    break
        self.step, self.fail, self.pops = step, fail, pops

    def count(self, word: bytes) -> int:
        step, fail, pops = self.step, self.fail, self.pops
        at = n = 0
        for b in word:
            to = step.get(at << 8 | b)
            while to is None:
                n += pops[at]
                at = fail[at]
                if at < 0:
                    return -1
                to = step.get(at << 8 | b)
            at = to
        while at:
            n += pops[at]
            at = fail[at]
            if at < 0:
                return -1
        return n


class _Memo(dict):
    def __init__(self, counter: PieceCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: str) -> int:
        n = self[word] = max(1, self.counter.count(b" " + word.encode()))  # a word that can't be matched is one unknown piece
        return n


@cache
def _memo(path: str) -> _Memo:
    with open(path, "rb") as f:
        return _Memo(PieceCounter(base64.b64decode(line.split()[0]) for line in f if line.strip()))


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``df`` without its text, with n_bytes, n_words and n_tokens (long) of each whole text.

    ``vocabulary``: path of a file of base64 entries and ranks, on every node.  Null and empty texts count 0;
    repeated rows count each; columns of those names are replaced; an empty table gives an empty table.
    A word of which some byte starts no entry counts as one unknown piece.
    """
    new = {"n_bytes": "long", "n_words": "long", "n_tokens": "long"}
    split = re.compile("[\x20\x09-\x0d]+").split

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        memo = _memo(vocabulary)
        for batch in batches:
            rows: list[tuple[int, int, int]] = []
            for value in batch.column(text):
                t = value.as_py() or ""
                words = [w for w in split(t) if w]
                rows.append((len(t.encode()), len(words), sum(map(memo.__getitem__, words))))
                if len(memo) > REMEMBER:
                    memo.clear()
            rest = batch.select([n for n in batch.schema.names if n != text])
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield put(rest, {k: pa.array(c, pa.int64()) for k, c in zip(new, cols, strict=True)})

    return df.mapInArrow(run, out_schema(df.drop(text), new))


def sql(vocabulary: str) -> str:
    """DuckDB for count_tokens() of ``documents``: the longest entry at every byte of every distinct word, then step by step."""
    return f"""
WITH RECURSIVE vocab AS MATERIALIZED (SELECT hex(from_base64(split_part(line, ' ', 1))) AS t FROM (SELECT unnest(string_split(content, chr(10))) AS line FROM read_text('{vocabulary}')) WHERE line <> ''),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
each AS MATERIALIZED (SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word FROM d),
words AS MATERIALIZED (SELECT word, hex(encode(' ' || word)) AS h FROM (SELECT DISTINCT word FROM each)),
sized AS MATERIALIZED (SELECT word, h, CAST(len(h) // 2 AS BIGINT) AS n FROM words),
starts AS (SELECT word, h, n, unnest(range(0, n)) AS p FROM sized),
tries AS (SELECT word, p, k, substr(h, 2 * p + 1, 2 * k) AS t FROM (SELECT *, unnest(range(1, least(n - p, (SELECT max(len(t)) // 2 FROM vocab)) + 1)) AS k FROM starts)),
best AS MATERIALIZED (SELECT word, p, max(k) AS k FROM tries SEMI JOIN vocab USING (t) GROUP BY word, p),
walk AS (SELECT word, 0::BIGINT AS p, 0::BIGINT AS pieces FROM sized UNION ALL SELECT w.word, w.p + b.k, w.pieces + 1 FROM walk w JOIN best b ON b.word = w.word AND b.p = w.p),
counted AS (SELECT s.word, coalesce(max(w.pieces) FILTER (w.p = s.n), 1) AS pieces FROM sized s JOIN walk w ON w.word = s.word GROUP BY s.word)
SELECT d.doc_id, CAST(octet_length(encode(any_value(d.text))) AS BIGINT) AS n_bytes, count(each.word) AS n_words, CAST(coalesce(sum(pieces), 0) AS BIGINT) AS n_tokens
FROM d LEFT JOIN each ON each.r = d.r LEFT JOIN counted ON counted.word = each.word GROUP BY d.r, d.doc_id
"""
