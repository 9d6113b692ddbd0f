"""The line source on its own, and a query over it that stops and starts again."""

import random
import time

from webstrata.sources import url_stream as U


def batches(reader):
    while (end := reader.latestOffset()) != reader.at:
        assert reader.latestOffset() == end  # the same until it is planned
        start = reader.at
        yield [(n, v) for p in reader.partitions(start, end) for b in reader.read(p) for n, v in zip(*(c.to_pylist() for c in b.columns), strict=True)]


def test_every_line_once(tmp_path, monkeypatch):
    rng, f = random.Random(1), tmp_path / "l.txt"
    monkeypatch.setattr(U, "BLOCK", 7)
    for _ in range(60):
        texts = ["".join(rng.choices("ab é\r", k=rng.choice([0, 1, 5, 30]))) for _ in range(rng.randint(0, 25))]
        raw = "\n".join(texts) + rng.choice(["", "\n"])
        f.write_bytes(raw.encode())
        want = raw.split("\n")[: -1 if raw.endswith("\n") or not raw else None]
        most, share = rng.randint(1, 9), rng.randint(1, 4)
        reader = U.LineReader({"path": str(f), "linesPerTrigger": str(most), "linesPerTask": str(share)})
        got = list(batches(reader))
        assert [x for b in got for x in b] == list(enumerate(t.removesuffix("\r") for t in want))
        assert all(len(b) == most for b in got[:-1])


def test_a_list_that_grows(tmp_path):
    f = tmp_path / "g.txt"
    f.write_text("a\nb")
    reader = U.LineReader({"path": f.as_uri(), "follow": "true"})
    assert [x for b in batches(reader) for x in b] == [(0, "a")]
    f.write_text("a\nbc\nd\n")
    again = U.LineReader({"path": str(f), "follow": "true"})
    assert again.partitions(reader.at, reader.at) == [] and again.at == reader.at  # how Spark tells a new reader where it is
    assert [x for b in batches(again) for x in b] == [(1, "bc"), (2, "d")]


def wait(condition, seconds=60):
    end = time.time() + seconds
    while not condition():
        assert time.time() < end, "the stream does not come on"
        time.sleep(0.2)


def test_bounded_batches_and_resume(spark, tmp_path):
    """10 000 lines arrive in batches of 1 500 at most; a second query goes on where the first was stopped."""
    f, out, c = tmp_path / "urls.txt", tmp_path / "out", tmp_path / "c"
    f.write_text("".join(f"host{i}.example.com/p{i}\n" for i in range(10_000)))
    seen = []

    def start():
        def keep(batch, number):
            seen.append((number, batch.count()))
            batch.write.mode("overwrite").parquet(str(out / str(number)))

        return U.stream_lines(spark, str(f), 1_500, 400).writeStream.foreachBatch(keep).option("checkpointLocation", str(c)).start()

    q = start()
    wait(lambda: len(seen) >= 2 or q.exception())
    q.stop()
    first = {n for n, _ in seen}
    assert first and sum(n for _, n in dict(seen).items()) < 10_000
    q = start()
    wait(lambda: (out / "6").exists() and max(n for n, _ in seen) == 6 or q.exception())
    time.sleep(1)
    q.stop()
    assert q.exception() is None
    sizes = dict(seen)
    assert set(sizes) == set(range(7)) and all(sizes[n] == 1_500 for n in range(6)) and sizes[6] == 1_000
    rows = spark.read.parquet(*[str(out / str(n)) for n in range(7)]).collect()
    assert sorted(r.line_number for r in rows) == list(range(10_000)) and all(r.value == f"host{r.line_number}.example.com/p{r.line_number}" for r in rows)


def test_described(spark, tmp_path):
    f = tmp_path / "u.txt"
    f.write_text("# no\n\nwww.example.co.uk/a\nhttp://10.0.0.1/\n")
    q = U.stream_url_list(spark, str(f)).writeStream.format("memory").queryName("listed").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert {r.line: (r.url, r.domain, r.allowed) for r in spark.table("listed").collect()} == {"www.example.co.uk/a": ("https://www.example.co.uk/a", "example.co.uk", True), "http://10.0.0.1/": ("http://10.0.0.1/", "10.0.0.1", False)}
