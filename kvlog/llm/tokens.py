"""BPE ids and decoded texts of whole tables."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlog.llm.bpe import Encoder, made
from kvlog.llm.common import doc_id, keyed, ship
from kvlog.llm.text import slices


def encode_documents(docs: DataFrame, vocabulary: str, with_values: bool = False) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_tokens, ids_sha256`` (decimal ids joined by one
    space), ``decoded_sha256`` and, with ``with_values``, ``ids`` and ``decoded``.

    ``vocabulary`` is a tokenizers file of a BPE with word ends; every executor must have
    it. Null and empty texts have no tokens and decode to the empty text.
    """
    ship(docs.sparkSession)
    schema = "k long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_values

    def run(batches):
        encoder = made(Encoder, vocabulary)
        for batch in batches:
            for b in slices(batch):
                n, first, second, ids, texts = [], [], [], [], []
                for text in b.column(1).to_pylist():
                    parts = encoder.encode(text)
                    line = " ".join([p[0] for p in parts if p[2]])
                    decoded = " ".join([p[1] for p in parts if p[2]])
                    n.append(sum([p[2] for p in parts]))
                    first.append(hashlib.sha256(line.encode()).hexdigest())
                    second.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_values:
                        ids.append([int(i) for i in line.split()])
                        texts.append(decoded)
                cols = [b.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
                names = ["k", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_values:
                    cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    out = keyed(docs).mapInArrow(run, schema)
    return out.select(doc_id(), *[F.col(c) for c in out.columns if c != "k"])
