import hashlib

from brindle.sources.fetch import FETCHERS, fetch, summary, verified

TASK = "source_id string, source_type string, address string"


def test_fetching_is_routed_retried_and_checked(spark, tmp_path):
    (tmp_path / "a b.txt").write_bytes(b"hello world")
    counter = tmp_path / "tries"

    def shaky(address):
        n = len(counter.read_text()) if counter.exists() else 0
        counter.write_text("x" * (n + 1))
        if n < 2:
            raise OSError("not yet")
        return b"late"

    path = str(tmp_path / "a b.txt")
    tasks = [("1", "local", path), ("2", "local", "file://" + path.replace(" ", "%20")), ("2", "local", "/aaa"), ("3", "local", "/no/such/file"), ("4", "ftps", "x"), ("5", "shaky", "s"), ("6", "local", None), (None, "local", path)]
    out = fetch(spark.createDataFrame(tasks, TASK), {**FETCHERS, "shaky": shaky}, 2, 0.01)
    rows = {r.source_id: r for r in out.collect()}
    digest = hashlib.sha256(b"hello world").hexdigest()
    assert set(rows) == set("123456") and (rows["1"].size_bytes, rows["1"].sha256, rows["1"].attempts) == (11, digest, 1) and rows["2"].success
    assert not rows["3"].success and rows["3"].attempts == 3 and "FileNotFoundError" in rows["3"].error
    assert rows["4"].attempts == 0 and rows["6"].attempts == 0 and (rows["5"].success, rows["5"].attempts, bytes(rows["5"].content)) == (True, 3, b"late")
    kept = spark.createDataFrame([tuple(r) for r in rows.values()], out.schema)
    assert tuple(summary(kept).first()) == (6, 3, 3, 2, 26) and tuple(summary(kept.limit(0)).first()) == (0, 0, 0, 0, 0)
    want = spark.createDataFrame([("1", 11, digest), ("2", 10, digest), ("3", 11, digest), ("9", 1, "x")], "source_id string, size_bytes long, sha256 string")
    assert {r.source_id: r.intact for r in verified(kept, want).collect()} == {"1": True, "2": False, "3": False, "9": False}
