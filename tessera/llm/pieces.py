"""SentencePiece encoding and decoding over distinct-chunk tables.

No piece of the models this accepts holds a whitespace marker after another character (checked when
the model is loaded), so no merge crosses the start of a marked word: a text is the concatenation of
its marked words, and so are its ids.  Each task builds the table of its distinct marked words, lot by
lot, segments each of them once (a table beyond TABLE_BYTES is begun anew), and joins ids and decoded
surfaces back by position.  The table goes when the task ends.

Defined results: a null or empty text has the end id alone and decodes to the empty text; repeated
rows give repeated results; texts of any length are segmented whole, a very long one in a lot of its own; a
word has one segmentation, so ties don't arise; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import lean, lots

MARK = "▁"
#: Bytes of a task's table, besides the words of the lot at hand, and those that an entry has beside its word and ids.
TABLE_BYTES, ENTRY_BYTES = 96 << 20, 200
#: Rows that are worked on together.
ROWS = 256

_CHUNK = re.compile(" +[^ ]*")


class ChunkTable:
    """Distinct marked words of a model, each without its first marker, with their ids and, where it differs, their decoded surface."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        crossing = [i for i in range(self.sp.get_piece_size()) if MARK in self.sp.id_to_piece(i).lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces cross whitespace markers, e.g. id {crossing[0]}")
        if self.sp.decode(self.sp.encode("  x\u2460 ")) != "  x\u2460 ":
            raise ValueError("the model's normaliser changes texts; words can't be segmented by themselves")
        size = range(self.sp.get_piece_size())
        self.decimal = [str(i) for i in size]
        #: The bytes of a piece wherever it stands; None for unknown and control ids, whose words the library decodes.
        self.plain = [bytes([int(self.sp.id_to_piece(i)[3:5], 16)]) if self.sp.is_byte(i) else None if self.sp.is_control(i) or self.sp.is_unknown(i) else self.sp.id_to_piece(i).replace(MARK, " ").encode() for i in size]
        self.eos = self.sp.eos_id()
        self.mark = self.sp.piece_to_id(MARK)
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, str | bytes] = {}
        self.surface: dict[str, str] = {}
        self.size = 0

    def words(self, text: str) -> list[str]:
        """The text's marked words without the marker that begins each (the first word's is the model's own); further markers stay, as blanks."""
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return [w[1:] for w in _CHUNK.findall(" " + text)]
        return text.split(" ") if text else []

    def segment(self, distinct: set[str], decimal: bool) -> None:
        """Segments those words that the table lacks, ids in decimal or as 32-bit numbers.  A table beyond its bound is begun anew first."""
        missing = [w for w in distinct if w not in self.ids]
        if missing and self.size > TABLE_BYTES:
            self.clear()
            missing = list(distinct)
        if not missing:
            return
        names, plain = self.decimal, self.plain
        for w, ids in zip(missing, self.sp.encode(missing, num_threads=1), strict=True):
            ids = ids if w else [self.mark]  # a marker alone has an empty rest
            self.ids[w] = found = " ".join([names[i] for i in ids]) if decimal else array("i", ids).tobytes()
            self.size += ENTRY_BYTES + len(w) + len(found)
            if not w:
                continue
            try:
                back = b"".join([plain[i] for i in ids]).decode()[1:]
            except (TypeError, UnicodeDecodeError):
                back = self.sp.decode(ids)
            if back != w:
                self.surface[w] = back

    def encode(self, texts: list[str], decimal: bool) -> Iterator[tuple[int, str | bytes, str]]:
        """For each text: its number of ids, the ids, in decimal or as 32-bit numbers, both with the end id, and the decoded text.

        The table holds ids of one of the two forms; clear() comes between them.
        """
        split = [self.words(t) for t in texts]
        self.segment(set().union(*split), decimal)
        ids, surface = self.ids, self.surface
        for words in split:
            if decimal:
                found = " ".join([ids[w] for w in words] + [str(self.eos)])
                n = found.count(" ") + 1
            else:
                found = b"".join([ids[w] for w in words] + [array("i", [self.eos]).tobytes()])
                n = len(found) // 4
            yield n, found, " ".join([surface.get(w, w) for w in words] if surface else words)


@functools.cache
def chunk_table(model: str) -> ChunkTable:
    """A worker's model; its tasks empty the table as they end."""
    return ChunkTable(model)


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", *, full: bool = True) -> DataFrame:
    """Rows (id, n_tokens, ids, decoded), or their digests (id, n_tokens, ids_sha256, decoded_sha256) if not full.

    model: path of the model file, on every executor.
    """
    from pyspark.sql import types as T

    kept = df.select(id_col, text_col)
    fields = [kept.schema[0], T.StructField("n_tokens", T.LongType())]
    if full:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    else:
        fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model)
        table.clear()
        for batch in lots(batches, 1, ROWS):
            rows = list(table.encode([t or "" for t in batch.column(1).to_pylist()], not full))
            n = [r[0] for r in rows]
            if full:
                ids = np.frombuffer(b"".join([r[1] for r in rows]), np.int32)
                a = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(ids))
                b = pa.array([r[2] for r in rows], pa.string())
            else:
                a, b = (pa.array([hashlib.sha256(r[i].encode()).hexdigest() for r in rows], pa.string()) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), a, b], [f.name for f in fields])
        table.clear()

    return kept.mapInArrow(lean(run), T.StructType(fields))
