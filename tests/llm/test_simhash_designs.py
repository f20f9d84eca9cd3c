import pytest

from loomwork.llm import simhash


def test_designs_guarantee_the_bytes_that_long_lists_are_keyed_by():
    with pytest.raises(ValueError):
        simhash.Design(words=5, lanes=4, checked=2, radius=20, least=0, triples=((0, 1, 2),))
    assert simhash.CONTRACT.least == 8 * simhash.CONTRACT.checked - simhash.CONTRACT.radius == 4
