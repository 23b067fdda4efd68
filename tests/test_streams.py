import random

from sievelake.plans.session import scratch_path
from sievelake.queries import _scattered, _streamed
from sievelake.streaming import writers

SCHEMA = "label string, seq int, data binary, is_last boolean"


def test_lines_over_chunks(spark):
    rows = [("a", 0, b"se", False), ("a", 1, b"cret\r\n\nne", False), ("a", 2, b"xt", True), ("b", 0, b"one\n", True), ("c", 0, None, True)]
    out = _streamed(spark, _scattered(spark.createDataFrame(rows, SCHEMA)), writers.assemble_lines)
    assert sorted(map(tuple, out.collect())) == [("a", "next", 9, 3), ("a", "secret", 0, 1), ("b", "one", 0, 1)]


def test_windows_over_chunks(spark):
    data = bytes(range(65, 90)) * 4
    rows = [("a", i, data[i * 7 : i * 7 + 7], i * 7 + 7 >= len(data)) for i in range((len(data) + 6) // 7)]
    out = _streamed(spark, _scattered(spark.createDataFrame(rows, SCHEMA)), lambda s: writers.assemble_windows(s, 30, 10))
    got = sorted((r.window_start, r.owned_end, bytes(r.content)) for r in out.collect())
    assert got == [(s, 100 if s == 80 else s + 20, data[s : s + 30]) for s in (0, 20, 40, 60, 80)]


def in_turns(spark, batches, operator):
    """What a stream gives that meets each of ``batches`` in a micro-batch of its own, in this order."""
    source, sink, state = (scratch_path(spark, x) for x in ("chunks", "streamed", "offsets"))
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        out = operator(spark.readStream.schema(SCHEMA).parquet(source))
        out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


def test_chunks_out_of_order_across_micro_batches(spark):
    text = b"".join(b"line %d\n" % k for k in range(40)) + b"end"
    chunks = [("a", i, text[i * 9 : i * 9 + 9], i * 9 + 9 >= len(text)) for i in range(-(-len(text) // 9))]
    random.Random(1).shuffle(chunks)
    turns = [chunks[:12], chunks[12:25] + chunks[3:6], chunks[25:]]  # some come twice
    out = in_turns(spark, turns, writers.assemble_lines)
    lines = text.split(b"\n")
    assert sorted((r.line_no, r.byte_offset, r.line) for r in out.collect()) == [(k + 1, sum(len(x) + 1 for x in lines[:k]), x.decode()) for k, x in enumerate(lines)]
    out = in_turns(spark, turns, lambda s: writers.assemble_windows(s, 100, 20))
    got = sorted((r.window_start, bytes(r.content)) for r in out.collect())
    assert got == [(s, text[s : s + 100]) for s in range(0, len(text) - 20, 80)]


def test_a_long_line_takes_time_in_proportion():
    class State:
        exists = False

        def update(self, value):
            self.value = value

    import pandas as pd

    chunks = pd.DataFrame({"seq": range(20_000), "data": [b"x" * 100] * 20_000, "is_last": [False] * 20_000})
    state = State()
    assert sum(len(x) for x in writers._lines(("a",), iter([chunks]), state)) == 0 and sum(map(len, state.value[0])) == 2_000_000
