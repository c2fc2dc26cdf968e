"""Many small entries: read by Arrow where that is the same, handed on together, archives opened and listed once."""

import io
import zipfile

import pyarrow as pa
import pytest

from scanlytics.schema import NULL_TOKENS
from scanlytics.sources import archives as A

PLAIN = [
    "hour,scanCount\n2024-01-01,1\n2024-01-02,NA\n",
    " hour , state \n2024 , x \n,\n",
    "hour,state\n" + "".join(f"{t},1\n" for t in NULL_TOKENS),
    "projectName,state\n007,1.50\né,True",
]
OTHER = [
    "state\nx\n", "hour,hour,state\na,b,c\n", "hour,,state\na,b,c\n", "hour,state,\na,b,\n", 'hour,state\n"a,b",c\n',
    "hour,state\r\na,b\r\n", "﻿hour,state\na,b\n", "hour,state\na\n", "hour,state\na,b\n\nc,d\n", "hour,state\n  \na,b\n",
    "hour,state\n",
]


def _read(text):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        archive.writestr("a.csv", text)
    with zipfile.ZipFile(packed) as archive:
        return [row for batch in A._entry_batches(archive, "p", "a.csv") for row in batch.to_pylist()]


@pytest.mark.parametrize("text", [*PLAIN, *OTHER])
def test_small_entries_are_read_as_pandas_reads_them(text, monkeypatch):
    assert (A._plain_table(text.encode()) is not None) == (text in PLAIN)
    got = _read(text)
    monkeypatch.setattr(A, "_SMALL_BYTES", -1)
    assert got == _read(text)


def test_small_batches_are_handed_on_together(monkeypatch):
    monkeypatch.setattr(A, "_BATCH_ROWS", 10)
    batches = [pa.RecordBatch.from_pydict({"x": [i, i]}) for i in range(12)]
    found = list(A._gathered(iter(batches)))
    assert [b.num_rows for b in found] == [10, 10, 4]
    assert pa.Table.from_batches(found).to_pydict() == pa.Table.from_batches(batches).to_pydict()


def test_an_archive_is_opened_once_for_its_entries(spark, tmp_path, monkeypatch):
    folder, seen = tmp_path / "logs", tmp_path / "seen"
    folder.mkdir()
    seen.mkdir()
    for k in range(3):
        with zipfile.ZipFile(folder / f"{k}.zip", "w") as archive:
            for e in range(4):
                archive.writestr(f"{e}.csv", f"hour,scanCount\n2024-01-01,{k}\n2024-01-02,{e}\n")

    plain, opened = A.open_file, str(seen)

    def counting(path):
        import uuid

        open(f"{opened}/{uuid.uuid4().hex}", "w").close()
        return plain(path)

    entries = A.plan_entries(A.archive_files(spark, str(folder))).selectExpr("archive", "entry", "0 as task").cache()
    entries.count()
    monkeypatch.setattr(A, "open_file", counting)
    rows = A.entry_rows(entries, "", 1).toPandas()
    assert len(rows) == 24 and len(list(seen.iterdir())) == 3
    assert rows.groupby(["archive", "source_file"])["row_no"].apply(list).map(lambda n: n == [0, 1]).all()
