"""Collision counting: what a block costs, and that its windows are the same in whatever order queries come."""

import time

import numpy as np

from marlstone.llm import neighbours


def test_an_answer_does_not_depend_on_the_query_before():
    rng = np.random.default_rng(1)
    index = rng.normal(size=(3000, 64))
    queries = np.concatenate([rng.normal(size=(6, 64)), 1e4 * rng.normal(size=(2, 64)), rng.normal(size=(4, 64)), index[:3], np.full((1, 64), 1e-9)])
    together = list(neighbours.search_block(index, queries, 11))
    for i, found, d in together:
        ((_, alone, e),) = neighbours.search_block(index, queries[i : i + 1], 11)
        assert found.tolist() == alone.tolist() and d.tolist() == e.tolist()


def test_a_query_reads_its_windows_alone():
    """A query against a whole block takes no more than a few passes over it; with lines laid out entry by entry every search copied the block 128 times."""
    rng = np.random.default_rng(2)
    index, queries = rng.normal(size=(neighbours.BLOCK, 64)), rng.normal(size=(60, 64))
    began = time.process_time()
    sum(range(5_000_000))
    unit = time.process_time() - began
    began = time.process_time()
    assert not list(neighbours.search_block(index, queries[:0], 11))
    built = time.process_time() - began
    list(neighbours.search_block(index, queries, 11))
    each = (time.process_time() - began - 2 * built) / len(queries)
    assert each < 0.14 * unit
