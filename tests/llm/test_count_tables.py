"""Sums of many tasks' count tables."""

import numpy as np

from marlstone.llm.tables import PART, summed, table_parts


def test_tables_of_many_tasks_add_up_beyond_32_bits(spark):
    def tables(it):
        total = np.zeros((2, 4), np.int32)
        for batch in it:
            for x in batch.column(0).to_pylist():
                total[x % 2, x % 3] += 2**30
        yield from table_parts(total, 2)

    n = 150
    want = np.zeros((2, 4), np.int64)
    for x in range(n):
        want[x % 2, x % 3] += 2**30
    got = summed(spark.range(0, n, 1, n).mapInArrow(tables, PART), 2, 8)
    assert got.reshape(2, 4).tolist() == want.tolist() and want.max() > 2**31


def test_no_rows_and_no_counts(spark):
    none = lambda it: (b for batch in it for b in table_parts(np.zeros(8, np.int32), 2))
    assert summed(spark.range(4).mapInArrow(none, PART), 2, 8).sum() == 0
    assert summed(spark.range(0).mapInArrow(none, PART), 2, 8).shape == (2, 4)


def test_weights_of_the_mixer_are_learnt_from_every_training_document(spark):
    """More documents, and longer ones, than any sample: the sums hold each decision of all of them, whatever the partitions."""
    import numpy as np
    import pyarrow as pa

    from marlstone.llm import mixing as m

    texts = [f"the {k % 7} cat {k % 3} sat on mat{k}" for k in range(900)] + ["a long text of many words " * 6000]
    codes = m.Codes.build(np.array([], np.uint64), np.array([], np.int64), 0, 1)
    counts = np.zeros((m.ORDERS, 1 << m.SLOT_BITS, 2), np.int64)
    counts[0, :, 1] = 3
    told = m.leave_one_out(counts)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    b = [spark.sparkContext.broadcast(x) for x in (codes, told)]
    got = m.weight_sums(docs.repartition(5), *b)
    assert (got == m.weight_sums(docs.repartition(2), *b)).all()
    total = 0
    for _, data, off in m.slices(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])):
        t = m.tokens_of(data, off, codes)
        total += len(m.decisions(t, np.arange(len(t.code)), codes)[2])
    # the constant input's entry is the sum of p(1 - p), which no decision leaves at 0 here
    assert got[:, -1, m.ORDERS].sum() > 0.07 * total
    assert m.learned_weights(got).shape == (m.GATES, m.ORDERS + 1)


def test_decisions_by_depth_hold_each_tokens_own_ones():
    """symbols' sums over their decisions are those of a plain walk, token by token, and no more tokens are worked on at once than fit a cache."""
    import numpy as np

    from marlstone.llm import mixing as m

    data = np.frombuffer(b"the cat sat on the mat xyzzy the end", np.uint8)
    off = np.array([0, 14, 14, len(data)])
    starts, ends, _ = m.words(data, off)
    known = np.unique(m.span_hash(data, starts, ends))[1:]  # one of the words is spelt
    codes = m.Codes.build(known, np.arange(len(known)) + 2, 1, 3)
    t = m.tokens_of(data, off, codes)
    owner, slots, bit, spelt, bounds = m.decisions(t, np.arange(len(t.code)), codes)
    assert slots.shape == (m.ORDERS, len(bit)) and m.SOME_TOKENS * 13 * 8 <= 1 << 19
    assert (m.sizes(bounds) == m.gathered(np.ones(len(bit)), bounds)).all()
    assert (m.spread(np.arange(len(owner)), bounds, np.zeros(len(bit), int))[: len(owner)] == np.arange(len(owner))).all()
    want = np.zeros(len(t.code), int)
    for k, c in enumerate(t.code.tolist()):
        want[k] = codes.size[c] + (8 * (t.end[k] - t.start[k] + 1) if c == len(known) else 0)
    assert (np.bincount(owner, m.sizes(bounds)) == want).all() and spelt.sum() * 8 == sum(want) - codes.size[t.code].sum()
    first = np.bincount(owner[~spelt], m.gathered(bit.astype(int), bounds)[~spelt])
    assert first.tolist() == [codes.bits[codes.start[c] : codes.start[c] + codes.size[c]].sum() for c in t.code.tolist()]


def test_a_whole_number_of_tenths_tells_the_first_errors():
    """probabilities read from a table are those of the first weights."""
    import numpy as np

    from marlstone.llm import mixing as m

    chance, variance = m.first_errors()
    rng = np.random.default_rng(3)
    x = rng.integers(-1500, 1500, (m.ORDERS, 500))
    z = m.first_weights()[0, : m.ORDERS] @ (x / m.UNIT)
    p = 1 / (1 + np.exp(-np.clip(z, -m.CLIP, m.CLIP)))
    at = np.rint(m.first_weights()[0, : m.ORDERS] * 10).astype(int) @ x + (1 << 15)
    assert np.abs(chance[at] - p * m.STEPS).max() <= 0.5001 and np.abs(variance[at] - p * (1 - p) * m.STEPS).max() <= 0.5001
