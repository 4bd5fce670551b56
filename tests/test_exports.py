"""Export documents of several lines, many to a file."""

import json
import os

from pyspark.sql import functions as F

from haltbook.plans import q_more
from haltbook.sources import tables

AT = "/root/testdata/sf0.01"


def test_documents_of_several_lines_in_one_file(spark, tmp_path):
    docs = [{"sourceUrl": u, "messages": [{"messageDate": d, "time": "10:00", "text": t} for d, t in m]} for u, m in
            [("a", [("2024-01-02", "one\ntwo"), (" ", "gone"), ("2024-01-03", "\x1e three\x1e\r\n")]), ("b", []), ("c", [("2024-01-02", "ä")])]]
    text = "".join(json.dumps(d, indent=2, ensure_ascii=False) + tables.RECORD_END for d in docs)
    (tmp_path / "some.json").write_text(text, encoding="utf-8", newline="")
    got = sorted((r.chat_key, r.pos, r.raw_date, r.text) for r in tables.read_chat_export(spark, str(tmp_path), separator=tables.RECORD_END).collect())
    assert got == [("a", 0, "2024-01-02", "one\ntwo"), ("a", 2, "2024-01-03", "\x1e three\x1e"), ("c", 0, "2024-01-02", "ä")]


def test_files_do_not_grow_with_chats(spark, monkeypatch):
    paths = []
    real = q_more.scratch
    monkeypatch.setattr(q_more, "scratch", lambda *a: paths.append(real(*a)) or paths[-1])
    rows = q_more.s1_files(spark, AT)
    chats = spark.read.parquet(f"{AT}/conversations.parquet").select("conv_id").distinct().count()
    files = [x for _, _, names in os.walk(paths[0]) for x in names if x.startswith("part-")]
    assert len(files) <= 8 < chats
    assert "\n" in spark.read.text(paths[0], wholetext=True).first()[0]
    assert rows.where(F.col("text").isNull()).count() == 0
