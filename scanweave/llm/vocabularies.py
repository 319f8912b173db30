"""Vocabulary files of the installed public tokenizers."""

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def vocabulary_file(name) -> bytes:
    """The file as bytes; it is a few MB."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()
