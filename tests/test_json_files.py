"""Queries that write a table as JSON files and read it back: few files, and every row, also of odd names."""

import pyarrow as pa
import pyarrow.parquet as pq

from fleetsift.registry import load

NAMES = [*(f"Supplier {i}" for i in range(1_190)), 'a "b" \\ c', "line\nend\r\n\ttab", "\x01,\x00", " padded ", "# ümlaut [é] {}", "", None, "ŠKODA", "twice", "twice"]


def suppliers(folder):
    """A supplier table of 1,200 rows."""
    n = len(NAMES)
    table = pa.table({
        "s_suppkey": pa.array([None if i == 5 else i * 3 for i in range(n)], pa.int64()), "s_name": pa.array(NAMES),
        "s_nationkey": pa.array([None if i % 11 == 0 else i % 25 for i in range(n)], pa.int32()),
        "s_acctbal": pa.array([None if i % 13 == 0 else i - 300.0 for i in range(n)])})
    pq.write_table(table, folder / "supplier.parquet")
    return table.to_pylist()


def test_config_list_reads_few_files_and_every_row(spark, tmp_path):
    rows = suppliers(tmp_path)
    frame = load()[0]["scan_config_list"](spark, str(tmp_path))
    expected = [v for r in rows if r["s_name"] for v in (r["s_name"], r["s_name"].lower())]
    assert sorted(r.value for r in frame.collect()) == sorted(expected)
    assert 1 < len(frame.inputFiles()) <= 4


def test_rules_read_few_files_and_every_row(spark, tmp_path):
    rows = suppliers(tmp_path)
    frame = load()[0]["scan_rules"](spark, str(tmp_path))
    expected = []
    for r in rows:
        key, nation, balance = r["s_suppkey"], r["s_nationkey"], r["s_acctbal"]
        expected.append((
            "" if key is None else f"r{key}", r["s_name"] or "", "critical" if balance is not None and balance < 0 else "low",
            nation is None or nation % 2 == 0, None if nation is None else f"tag{nation}", None if nation is None else f"src_{nation}",
            '{"type":"item_ref","name":"x"}'))
    assert sorted(map(repr, map(tuple, frame.collect()))) == sorted(map(repr, expected))
    assert 1 < len(frame.inputFiles()) <= 4
