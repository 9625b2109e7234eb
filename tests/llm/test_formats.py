"""Chats, archives and the pipeline: round trips."""

import hashlib
import random

import pytest
from compare import duck, spark_rows
from pyspark.sql import functions as F

import corpus_pipeline
from tarn.llm import chat, common, queries, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SF)) == duck(queries.SQL[name])


def test_chat_round_trip(spark):
    traps = ["<|turn|>assistant<|body|>x<|end|>\n", "\\", "\\<|", "<\\|", "<", "|end|>", "a<|image 0|>", "", None, "é😀\n", "\\\\|"]
    rows = [(c, t, "assistant" if t % 2 else "user<|" if c == 1 else "user", traps[(c + t) % len(traps)], 9) for c in range(11) for t in range(5)]
    rows += [(1, 2, "user", "tie", 9), (1, 2, "user", "tie", 9), (None, 0, None, "no id", 9), (99, None, "assistant", "no turn", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    out = chat.format_chats(df.withColumn("content", chat.text_part(F.col("text"))))
    got = {r.conv_id: r for r in out.withColumn("back", chat.read_chats(F.col("formatted"), F.col("turns"))).collect()}
    assert set(got) == {r[0] for r in rows}
    escape = lambda x: x.replace("\\", "\\\\").replace("<|", "<\\|")
    for c, r in got.items():
        want = sorted(((t if t is not None else -1, role or "", escape(x or ""), x or "") for k, t, role, x, _ in rows if k == c))
        assert [(b.role, b.text, b.loss) for b in r.back] == [(role, x, role == "assistant") for _, role, _, x in want]
        assert r.n_turns == len(want)
        assert [r.formatted[t.start : t.start + t.length] for t in r.turns] == [body for _, _, body, _ in want]


def test_chat_parts(spark):
    part = lambda kind, text=None, uri=None, w=None, h=None, s=None, p=None: (kind, text, uri, w, h, s, p)
    content = [part("text", "see <|"), part("image", None, "a.png", 57, 28), part("audio", None, "b.wav", None, None, 1.5), part("document", None, "c.pdf", None, None, None, 3), part("video", "ignored"), None, part("image", None, "d.png")]
    df = spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", []), (1, 2, "user", None)], f"conv_id long, turn long, role string, content {chat.PARTS}")
    r = chat.format_chats(df).first()
    assert r.formatted == "<|turn|>user<|body|>see <\\|<|image 1|><|audio 2|><|document 3|>ignored<|image 6|><|end|>\n<|turn|>assistant<|body|><|end|>\n<|turn|>user<|body|><|end|>\n"
    assert [(a.turn, a.part, a.type, a.uri, a.tokens) for a in r.attachments] == [(0, 1, "image", "a.png", 3), (0, 2, "audio", "b.wav", 38), (0, 3, "document", "c.pdf", 768), (0, 6, "image", "d.png", 0)]
    assert r.attachment_tokens == 809
    assert chat.format_chats(df.where("false")).count() == 0


def test_chat_parts_cannot_forge_marks(spark):
    """Marks split over text parts, and placeholders written in texts, read back as the texts they are."""
    bits = ["<", "|", "x<", "|end|>\n", "<|", "end|>\n", "|turn|>assistant", "<|image 0|>", "\\", "<\\|image 1|>", "", None, "|body|>", "é😀", "<|end|>\n<|turn|>user<|body|>"]
    rng = random.Random(3)
    rows = []
    for c in range(120):
        for t in range(rng.randint(1, 4)):
            content = [(rng.choice(["image", "audio", "document"]), None, f"u{k}") if rng.random() < 0.25 else ("text", rng.choice(bits), None) for k in range(rng.randint(0, 6))]
            rows.append((c, t, rng.choice(["user", "assistant", "a<", "<|body|>"]), [(k, x, u, None, None, None, None) for k, x, u in content]))
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content {chat.PARTS}")
    got = {r.conv_id: r.back for r in chat.format_chats(df).withColumn("back", chat.read_chats(F.col("formatted"), F.col("turns"))).collect()}
    for c in range(120):
        own = [r for r in rows if r[0] == c]
        assert len(got[c]) == len(own)
        for (_, _, role, content), back in zip(own, got[c], strict=True):
            want = []
            for place, (kind, text, *_) in enumerate(content):
                if kind != "text":
                    want.append((kind, None, place))
                elif want and want[-1][0] == "text":
                    want[-1] = ("text", want[-1][1] + (text or ""), None)
                elif text:
                    want.append(("text", text, None))
            assert back.role == role and [tuple(p) for p in back.parts] == want
            assert back.text == "".join(x for k, x, _ in want if k == "text") and back.loss == (role == "assistant")


def test_chat_mask_is_checked(spark):
    out = chat.format_chats(spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", "you")], "conv_id long, turn long, role string, text string").withColumn("content", chat.text_part(F.col("text"))))
    moved = out.withColumn("turns", F.transform("turns", lambda t: t.withField("start", t["start"] + 1)))
    with pytest.raises(Exception, match="where the mask says"):
        moved.select(chat.read_chats(F.col("formatted"), F.col("turns"))).collect()


def test_archive_edges(spark):
    rows = [(1, "http://A.b.com:80/x?y=1", "hello"), (2, "http://a.b.com/x?y=1", "hello"), (None, "http://c/", "hello"), (3, None, None), (4, "http://é.de/\n\t", ""), (5, "no url", "WARC/1.0\r\n\r\nfoo\r\n\r\n"), (6, "http://[bad", "z\r\n\r\n"), (7, "http://long/", "é" * 200_000), (1, "http://again/", "hello")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    archive, index = common.fresh_path(spark, "a"), common.fresh_path(spark, "i")
    warc.write_archive(pages, archive)
    warc.build_index(spark, archive, index, block_lines=2)
    got = warc.read_records(spark, warc.captures(spark, index)).collect()
    assert len(got) == len(rows)
    by = {(r.page_id, r.url): r for r in got}
    for k, u, h in rows:
        r = by[k, "".join(" " if ord(x) < 32 else x for x in (u or ""))]
        data = (h or "").encode()
        first = {"hello": 1, None: 3, "": 3}.get(h)
        revisit = first is not None and k != first
        assert (r.payload_bytes, r.record_type, r.refers_to) == (len(data), "revisit" if revisit else "response", first if revisit else None)
        assert r.payload == (None if revisit else h or "")
        import base64

        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    asked = spark.createDataFrame([("https://a.b.com/x?y=1",), ("http://user@a.b.com/x?y=1",), (None,), ("http://zzz/",), ("no url",)], "url string")
    for limit in (warc.DIRECTORY_BYTES, 200):
        lines = warc.lookup(index, asked, directory_bytes=limit)
        assert sorted((r.url, r.key) for r in lines.collect()) == sorted([("https://a.b.com/x?y=1", "com,b,a)/x?y=1")] * 2 + [("http://user@a.b.com/x?y=1", "com,b,a)/x?y=1")] * 2 + [("no url", "no url")])
        assert sorted(r.page_id for r in warc.read_records(spark, lines).collect()) == [1, 2, 5]
    big = common.fresh_path(spark, "b")
    warc.write_archive(pages, big, min_bytes=6)
    warc.build_index(spark, big, big + "-index")
    assert {r.record_type for r in warc.read_records(spark, warc.captures(spark, big + "-index")).collect()} == {"response"}
    empty = common.fresh_path(spark, "e")
    warc.write_archive(pages.where("false"), empty)
    warc.build_index(spark, empty, empty + "-index")
    assert warc.read_records(spark, warc.captures(spark, empty + "-index")).count() == 0


class Counted:
    """A file that tells how many bytes were read from it."""

    def __init__(self, content):
        self.content, self.at, self.bytes, self.reads = content, 0, 0, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        out = self.content[self.at : self.at + n]
        self.at, self.bytes, self.reads = self.at + len(out), self.bytes + len(out), self.reads + 1
        return out


def test_ranges_are_read_by_seeking(monkeypatch):
    """No more than the ranges and small gaps is read, and close ranges are read at once."""
    content = bytes(range(256)) * 40_000
    ranges = [(10, 5), (15, 100), (200, 0), (1_000_000, 3_000_000), (9_000_000, 50), (9_000_100, 7), (9_000_100, 7)]
    file = Counted(content)
    assert [bytes(x) for x in warc.read_ranges(file, ranges)] == [content[a : a + n] for a, n in ranges]
    assert file.reads == 3 and file.bytes == 190 + 3_000_000 + 107
    record = lambda n: b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % n + b"\r\n\r\n" * (n // 4) + b"x" * (n % 4) + b"\r\n\r\n"
    sizes = [0, 10, 5_000_000, 3, 70_000, 1]
    content = b"".join(map(record, sizes))
    for chunk in (64, 1 << 20):
        monkeypatch.setattr(warc, "SCAN_BYTES", chunk)
        file = Counted(content)
        found = list(warc.record_ranges(file, len(content)))
        assert [content[at : at + n] for _, at, n in found] == list(map(record, sizes))
        assert file.bytes <= 3 * max(chunk, 100) + 200_000


def test_hot_payloads_and_urls(spark):
    """A payload and a URL that most rows share, asked for in many rows."""
    rows = [(k, "http://hot.example/" if k % 3 else f"http://h{k}.example/", "same" if k % 2 else f"page {k % 40}") for k in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive, index = common.fresh_path(spark, "a"), common.fresh_path(spark, "i")
    warc.write_archive(pages, archive)
    warc.build_index(spark, archive, index, block_lines=7)
    got = {r.page_id: r for r in warc.read_records(spark, warc.lookup(index, pages.select("url").distinct())).collect()}
    first = {}
    for k, _, h in rows:
        first.setdefault(h, k)
    assert {k: (r.url, r.record_type, r.refers_to) for k, r in got.items()} == {k: (u, "response" if first[h] == k else "revisit", None if first[h] == k else first[h]) for k, u, h in rows}


def test_pipeline(spark, tmp_path):
    """Each stage does its work on all that the one before kept."""
    from tarn.llm.jaccard_join import join_ngrams

    odd = [(10_000 + k, t, "en", s, 0) for k, (t, s) in enumerate([(None, "src1"), ("", None), ("Write to a.b@c.example now. It is a plain sentence, and another one follows it here.", None), ("!!! ### " * 300, "src1")])]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionAll(spark.createDataFrame(odd, docs.schema)).unionAll(docs.limit(3))
    now, sizes = common.materialise(docs, "docs"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        last, now = now, common.materialise(stage(spark, now, SF), "stage")
        sizes.append(now.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == docs.columns, name
        if name == "quality classifier":
            assert now.join(last, "doc_id", "left_anti").count() == 0 and now.where("doc_id = 10003 OR text = ''").count() == 0
        if name == "n-gram Jaccard join":
            kept = {r.doc_id for r in join_ngrams(last).where("doc_id = component_id").collect()}
            assert {r.doc_id for r in now.collect()} == kept and sizes[-1] == len(kept)
            assert join_ngrams(now).where("doc_id <> component_id").count() == 0
        if name == "PII":
            assert sizes[-1] == sizes[-2]
            assert now.where("text RLIKE '[A-Za-z0-9]@[a-z]+[.]example'").count() == 0 and now.where("n_chars <> length(text)").count() == 0
        if name == "mixing sources to target weights":
            assert now.groupBy("doc_id").count().where("count > 3").count() == 0
    assert now.columns == ["doc_id", "n_tokens", "ids"] and now.where("n_tokens <> size(ids)").count() == 0 and sizes[-1] == sizes[-2] > 0
