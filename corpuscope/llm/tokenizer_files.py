"""Where the public tokenizer files are."""


def tokenizer_file(name: str) -> str:
    """The path of an installed public tokenizer file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)
