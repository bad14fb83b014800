"""Text attachments of a folder are listed and read by tasks, as ``binaryFile`` reads them."""

from pyspark.sql import functions as F


def test_folder_equals_binary_files(spark, tmp_path, monkeypatch):
    from ticketscope.sources import files as SF
    top = tmp_path / "all files"
    for k in range(30):
        d = top / f"doc_id={k}" / ("deep" if k % 3 == 0 else ".")
        d.mkdir(parents=True)
        (d / "a.txt").write_bytes(f" text {k} é \n".encode())
        (d / "b.LOG").write_bytes("caf\xe9".encode("latin-1"))
    for name in ("_hidden.txt", ".also.txt", "c.pdf", "copy.txt._COPYING_", "_kept=1.txt", "empty.txt", "100%25 plain.txt"):
        (top / name).write_bytes(b"" if name.startswith("empty") else b"some text")
    (top / "_dir").mkdir()
    (top / "_dir" / "x.txt").write_text("not read")
    monkeypatch.setattr(SF, "READ_BYTES", 40)
    monkeypatch.setattr(SF, "LISTED", 4)

    def rows(df):
        return sorted((r.ticket_id, r.extracted_text, r.processed_count, r.confidence) for r in df.collect())

    folder = str(top)
    new = SF.src_text_attachments(spark, folder)
    assert not new.inputFiles()  # the plan holds no list of files
    assert rows(SF.src_text_attachments(spark, f"file://{folder}")) == rows(new)
    monkeypatch.setattr(SF, "_local_folder", lambda *a: None)
    old = SF.src_text_attachments(spark, folder)
    assert old.inputFiles() and rows(new) == rows(old) and len(rows(new)) == 31 - 9
    one = SF.src_text_attachments(spark, folder, ticket_of=F.regexp_extract("path", "doc_id=([0-9]+)", 1))
    assert one.count() == 31
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    kept = {r.path for r in paths.collect() if r.path.lower().endswith((".txt", ".log"))}
    assert {r.path for r in SF._folder_contents(spark, folder, SF.TEXT_EXTENSIONS).collect()} == kept
