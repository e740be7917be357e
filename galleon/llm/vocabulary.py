"""Pieces of a fixed public vocabulary. Vocabularies are read, never trained."""

from __future__ import annotations

from functools import lru_cache


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


#: The mark that the vocabulary puts before a word (a fixed value of its format).
WORD_START = "▁"


@lru_cache(maxsize=4)
def pieces(path: str) -> tuple[str, ...]:
    """The pieces in the order of their ids, without control, unknown and byte pieces (empty strings stand for those)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple("" if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) else model.id_to_piece(i) for i in range(model.get_piece_size()))
