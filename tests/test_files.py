import zlib

from paperloom.kernel.document import Document
from paperloom.kernel.syntax import Name, Ref, Stream
from paperloom.kernel.writer import file_of, synthesize
from paperloom.session import ship
from paperloom.sources import pdf
from paperloom.streaming import stream_pdf


def test_files_at_rest_and_as_they_arrive(spark, tmp_path):
    ship(spark)
    for i in range(3):
        (tmp_path / f"{i}.pdf").write_bytes(synthesize(f"file number {i}", {"Title": str(i)}))
    (tmp_path / "broken.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "other.txt").write_text("no document")
    want = sorted(["file", "number"] * 3 + ["0", "1", "2"])
    assert sorted(r.text for r in pdf.word_table(pdf.read_pdf(spark, str(tmp_path))).collect()) == want
    words = pdf.word_table(stream_pdf(spark, str(tmp_path), files_a_batch=2))
    run = words.writeStream.format("memory").queryName("arrived").option("checkpointLocation", f"{tmp_path}-state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(r.text for r in spark.table("arrived").collect()) == want


def test_object_streams_are_decoded_once(monkeypatch):
    n = 50
    bodies = [b"<< /K %d >>" % i for i in range(n)]
    heads, at = [], 0
    for i, b in enumerate(bodies):
        heads.append(b"%d %d" % (10 + i, at))
        at += len(b) + 1
    head = b" ".join(heads) + b" "
    objects = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: {"Type": Name("Pages"), "Count": 0, "Kids": []}, 3: Stream({"Type": Name("ObjStm"), "N": n, "First": len(head), "Filter": Name("FlateDecode")}, zlib.compress(head + b" ".join(bodies)))}
    doc = Document(file_of(objects, 1))
    doc.entries |= {10 + i: ("c", 3, i) for i in range(n)}
    calls, decoded = [], doc.decoded
    monkeypatch.setattr(doc, "decoded", lambda s: calls.append(1) or decoded(s))
    assert [doc.get(Ref(10 + i, 0)) for i in range(n)] == [{"K": i} for i in range(n)] and len(calls) == 1
