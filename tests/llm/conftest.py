"""Fixtures of the corpus operators."""

import pytest

WORDS = "amber basin cedar delta ember fjord grove haven inlet jetty knoll larch marsh north oasis prairie quarry ridge spruce tundra umber valley willow xenon yonder zephyr".split()


@pytest.fixture(scope="session")
def prose():
    """prose(seed, n): n words of repeatable text."""
    import random

    def make(seed, n, line=12):
        draw = random.Random(seed)
        words = [draw.choice(WORDS) + str(draw.randint(0, 40)) for _ in range(n)]
        return "\n".join(" ".join(words[k : k + line]) + "." for k in range(0, n, line))

    return make


@pytest.fixture(scope="session")
def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"
