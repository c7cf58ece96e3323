"""Bounded-space online packing of token sequences.

Every partition of the input is packed as a stream: at most ``open_windows`` windows are open; a piece goes to
the window that it fits best; when none has room, the fullest is emitted -- topped up with the head of the piece
if its gap has at least ``min_piece`` tokens -- and a new window opens. Documents longer than a window first
give whole windows. At the end of a partition the open windows' pieces are left over; they are merged in rounds
by the same algorithm, ``fan_in`` partitions to a task, until one task's windows remain, which are emitted. So a
task holds ``open_windows`` windows, or ``fan_in`` times as many in a merge round, whatever the size of the input.

Fault tolerance: each round is written to the shared folder before it is read. Packing a partition depends on
nothing but the partition, so a lost task is repeated with the same result.

Defined cases: a null or empty text is the one end id; repeated rows are packed each; null ids are packed
under a null doc_id; an empty table gives no piece. Texts are tokenized whole. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windlass.llm.common import batches, saved, whole_text

PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
         "ids binary, task long")


class ByteTokenizer:
    """Ids of a byte-level BPE vocabulary, ``<name>.json``. The same vocabulary is at hand as ranks, ``<name>.tiktoken``,
    which gives the same ids in a third of the time (tests compare them); a text that holds a special token's string
    goes through the vocabulary's own tokenizer."""

    def __init__(self, name: str = "byte_bpe_50k"):
        import base64

        import public_tokenizers as vocab
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(vocab.path(f"{name}.json"))
        self.special = [t.content for t in self.own.get_added_tokens_decoder().values()]
        with open(vocab.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> array:
        if any(s in text for s in self.special):
            return array("I", self.own.encode(text, add_special_tokens=False).ids)
        return array("I", self.fast.encode_ordinary(text))


class Packer:
    """Bounded-space best fit. ``put`` and ``close`` append finished pieces to ``rows``."""

    def __init__(self, size: int, open_windows: int, min_piece: int, first_id: int):
        self.size, self.most, self.min_piece = size, open_windows, min_piece
        self.next_id = first_id
        self.windows: list[list] = []  # [free tokens, pieces]
        self.rows: list[tuple] = []

    def emit(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            raw = ids.tobytes()
            self.rows.append((doc_id, start, len(ids), zlib.crc32(raw), doc_tokens, self.next_id, offset, None, 0))
            offset += len(ids)
        self.next_id += 1

    def put(self, doc_id, start: int, ids: array, doc_tokens: int) -> None:
        while len(ids) >= self.size:
            self.emit([(doc_id, start, ids[:self.size], doc_tokens)])
            start, ids = start + self.size, ids[self.size:]
        while len(ids):
            fits = [w for w in self.windows if w[0] >= len(ids)]
            if fits:
                best = min(fits, key=lambda w: w[0])
            elif len(self.windows) < self.most:
                best = [self.size, []]
                self.windows.append(best)
            else:
                best = min(self.windows, key=lambda w: w[0])  # the fullest
                if best[0] >= self.min_piece:
                    gap = best[0]
                    best[1].append((doc_id, start, ids[:gap], doc_tokens))
                    start, ids = start + gap, ids[gap:]
                self.windows.remove(best)
                self.emit(best[1])
                continue
            best[1].append((doc_id, start, ids, doc_tokens))
            best[0] -= len(ids)
            if not best[0]:
                self.windows.remove(best)
                self.emit(best[1])
            return

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows

    def left_over(self, task: int) -> list[tuple]:
        return [(d, s, len(ids), zlib.crc32(ids.tobytes()), n, -1, 0, ids.tobytes(), task)
                for _, pieces in self.windows for d, s, ids, n in pieces]

    def close(self) -> None:
        """Emit the open windows, the last ones cut to fill the fullest, so that one at most has a gap."""
        pieces = [p for _, held in sorted(self.windows, key=lambda w: w[0]) for p in held]
        self.windows, free, now = [], self.size, []
        for doc_id, start, ids, doc_tokens in pieces:
            while len(ids) >= free:
                self.emit([*now, (doc_id, start, ids[:free], doc_tokens)])
                start, ids, free, now = start + free, ids[free:], self.size, []
            if len(ids):
                now.append((doc_id, start, ids, doc_tokens))
                free -= len(ids)
        if now:
            self.emit(now)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECE.split(", ")])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    return frame


def pack(docs: DataFrame, size: int = 2048, open_windows: int = 16, min_piece: int = 16, fan_in: int = 16,
         end_id: int = 1, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def first_round(frames):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        tokens, packer = ByteTokenizer(vocabulary), Packer(size, open_windows, min_piece, task << 32)
        for frame in frames:
            texts = frame["text"].tolist()
            ids_of = frame["doc_id"].astype("Int64").tolist()
            for a, b in batches(texts):
                for doc_id, text in zip(ids_of[a:b], texts[a:b]):
                    ids = tokens.encode(text)
                    ids.append(end_id)
                    packer.put(None if doc_id is pd.NA else doc_id, 0, ids, len(ids))
                yield _frame(packer.taken())
        yield _frame(packer.left_over(task))

    def merge(last: bool, level: int):
        def one(frame: pd.DataFrame) -> pd.DataFrame:
            task = int(frame["task"].iloc[0]) // fan_in
            packer = Packer(size, open_windows, min_piece, (level << 56) | (task << 32))
            frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
            for d, s, n, raw in zip(frame["doc_id"], frame["start"], frame["doc_tokens"], frame["ids"]):
                packer.put(None if pd.isna(d) else int(d), int(s), array("I", raw), int(n))
            if last:
                packer.close()
            return _frame(packer.taken() + ([] if last else packer.left_over(task)))
        return one

    rows = saved(docs.select(F.col("doc_id").cast("long"), whole_text(F.col("text")).alias("text"))
                 .mapInPandas(first_round, PIECE), "packed")
    done, level = rows.filter("ids IS NULL"), 1
    tasks = (rows.filter("ids IS NOT NULL").agg(F.max("task")).first()[0] or 0) + 1
    while True:
        last = tasks <= fan_in
        rows = saved(rows.filter("ids IS NOT NULL").groupBy(F.floor(F.col("task") / fan_in).alias("merge"))
                     .applyInPandas(merge(last, level), PIECE), "packed")
        done, level, tasks = done.unionByName(rows.filter("ids IS NULL")), level + 1, -(-tasks // fan_in)
        if last:
            return done.drop("ids", "task")
