"""Exact token counts of texts of any length, by overlap resynchronisation.

A huge text is encoded in overlapping chunks. Two neighbouring encodings are spliced at a position of their overlap
that is a token boundary in both and at which the tokenizer provably splits whatever stands around it; where the
overlap holds none, it is widened, up to the whole rest of the text.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, text_slices

#: The pre-tokenizer of byte-level BPE never joins a visible character with white space after it, and a special
#: string holds no white space: between these two there is a boundary in every context. Only white space by everyone's
#: definition counts, and nothing that is so by anyone's (\s here holds U+001C to U+001F) counts as visible.
STABLE = re.compile(r"(?<=\S)(?=[ \t\n\r])")
#: Splices keep this far from a chunk's end, so that the looking ahead there can't have mattered.
MARGIN = 64


class Encoder:
    """Ids of one tokenizer file, without special tokens added and with special strings handled as by default.

    A byte-level BPE .json with its ranks beside it (same name, .tiktoken) is encoded through these ranks: the ids are
    the same, in a fraction of the time. Other .json files go through tokenizers, .model files through sentencepiece.
    """

    def __init__(self, path: str):
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        self.stable = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: model.encode(list(texts), num_threads=1)
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        byte_level = type(model.pre_tokenizer).__name__ == "ByteLevel" and model.normalizer is None
        if byte_level and os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as file:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            special = {t.content: i for i, t in model.get_added_tokens_decoder().items()}
            own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)
            every = set(special)
            #: bytes of each id
            self.lengths = np.zeros(max([*table.values(), *special.values()]) + 1, dtype=np.int64)
            for piece, i in table.items():
                self.lengths[i] = len(piece)
            for piece, i in special.items():
                self.lengths[i] = len(piece.encode())
            self.stable = True
            self._encode = lambda texts: [own.encode(t, allowed_special=every) if any(s in t for s in every) else own.encode_ordinary(t) for t in texts]
        else:
            self._encode = lambda texts: [e.ids for e in model.encode_batch_fast(list(texts), add_special_tokens=False)]

    def encode(self, texts) -> list[list[int]]:
        return self._encode(texts)

    def encode_long(self, text: str, chunk: int = 1 << 16, overlap: int = 1 << 10) -> list[int]:
        """The ids of a text, from chunks of about ``chunk`` characters that overlap by ``overlap`` or as far as it takes."""
        if not self.stable or len(text) <= chunk + overlap:
            return self._encode([text])[0]
        ids: list[int] = []
        at = 0
        while True:
            edge, wide, splice = at + chunk, overlap, None
            while splice is None and edge + wide < len(text):
                here = self._encode([text[at : edge + wide]])[0]
                beyond = self._encode([text[edge : edge + wide]])[0]
                splice = self._splice(text, at, edge, edge + wide, here, beyond)
                wide *= 2
            if splice is None:
                return ids + self._encode([text[at:]])[0]
            position, count = splice
            ids += here[:count]
            at = position

    def _splice(self, text, at, edge, end, here, beyond):
        """(position, tokens of ``here`` before it) of the first boundary of both encodings that is stable, or None."""
        ends_here = np.cumsum(self.lengths[here])
        ends_beyond = np.cumsum(self.lengths[beyond])
        start = len(text[at:edge].encode())
        for m in STABLE.finditer(text, edge + 1, end - MARGIN):
            offset = len(text[edge : m.start()].encode())
            i = bisect_left(ends_here, start + offset)
            j = bisect_left(ends_beyond, offset)
            if i < len(ends_here) and ends_here[i] == start + offset and j < len(ends_beyond) and ends_beyond[j] == offset:
                if here[i + 1 : i + 5] == beyond[j + 1 : j + 5]:
                    return m.start(), i + 1
        return None


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One a worker process and file."""
    return Encoder(path)


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 1024, chunk: int = 1 << 16, overlap: int = 1 << 10) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of each row.

    A null text is an empty one: 0 bytes, 0 tokens. Keys, null ones too, pass through; repeated rows give repeated
    results; an empty table gives none; other columns are not read.
    """
    schema = docs.select(key).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches):
        model = encoder(path)
        for batch in text_slices(batches, text):
            texts = [s or "" for s in batch.column(text).to_pylist()]
            short = [i for i, s in enumerate(texts) if len(s) <= chunk + overlap]
            counts = np.zeros(len(texts), dtype=np.int64)
            counts[short] = [len(x) for x in model.encode([texts[i] for i in short])]
            for i, s in enumerate(texts):
                if len(s) > chunk + overlap:
                    counts[i] = len(model.encode_long(s, chunk, overlap))
            sizes = [len(s) if s.isascii() else len(s.encode()) for s in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(sizes, pa.int64()), pa.array(counts), pa.array(counts > limit)],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(key, text).mapInArrow(run, schema)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), chunk=1 << 14)
