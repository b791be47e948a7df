"""Where the vocabulary files of the public tokenizers are."""


def tokenizer_path(name: str) -> str:
    """Path of a vocabulary file; the package that holds them is installed on every executor at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    """The pattern that the rank files' vocabularies cut texts by."""
    import public_tokenizers

    return public_tokenizers.PATTERN
