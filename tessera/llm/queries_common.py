"""What the queries and the pipeline share: the held-out fold and the vocabulary file."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that nothing is learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def tokenizer_path() -> str:
    """The public byte-level BPE vocabulary of this installation; found by each process for itself."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
