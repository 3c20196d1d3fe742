import pytest


@pytest.fixture(scope="session")
def odd_texts():
    """Texts that operators must take: null, empty, blank, very long, repeated, with signs of all kinds."""
    return [None, "", " ", "\n\n", "a", "word " * 30_000, "x" * 200_000, "😀 é ß 漢字 ▁  ", "same text twice here now", "same text twice here now", "1" * 5000, "a.b@c.d " * 50]
