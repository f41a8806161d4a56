"""Where the public tokenizer files are."""

from __future__ import annotations


def tokenizer_file(name: str) -> str:
    """The installed file of that name."""
    import public_tokenizers

    return public_tokenizers.path(name)
