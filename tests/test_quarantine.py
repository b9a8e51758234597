"""One row's failure is a row of the report; the others go on."""

from tessera.operators import quarantine, report


def size_of(content):
    if content is None:
        raise ValueError
    if not content.startswith(b"P5"):
        raise ValueError("not an image")
    return len(content)


def test_corrupt_photos_are_logged_and_the_batch_goes_on(spark):
    rows = spark.createDataFrame([("a", bytearray(b"P5 12")), ("b", bytearray(b"junk")), ("c", None), ("d", bytearray(b"P5"))], "item_id string, content binary")
    done = quarantine.guarded(rows, size_of, ["content"], "long").drop("content")
    good, bad = quarantine.split(done)
    assert {(r.item_id, r.value) for r in good.collect()} == {("a", 5), ("d", 2)}
    assert {(r.item_id, r.error) for r in bad.collect()} == {("b", "not an image"), ("c", "ValueError")}


def test_results_note_errors(spark):
    rows = spark.createDataFrame(
        [("1", "x.jpg", "OK", "12345", "processed_images", "Read.", "", None), ("2", "y.jpg", "OK", "12346", "processed_images", None, "READY", "no picture"), ("3", None, None, None, None, None, None, None),
         ("4", "z.jpg", "DUPLICATE_TAG", "12345", "processed_images", "Read.", None, None), ("5", "w.jpg", "OCR_FAILED", "", "review_required", "No text.", "FAILED", None), ("1", "x.jpg", "OK", "12345", "processed_images", "Read.", "", None)],
        "item_id string, original_filename string, status string, detected_tag_number string, output_folder string, notes string, correction_cache_status string, error string",
    )
    out = quarantine.results(rows)
    got = {r.item_id: r for r in out.collect()}
    assert out.count() == 6 and "error" not in out.columns
    assert got["1"].notes == "Read." and got["4"].notes.endswith("with suffix.") and got["5"].notes == "No text. Background preparation will retry after tag correction."
    assert (got["2"].status, got["2"].detected_tag_number, got["2"].output_folder, got["2"].original_filename) == ("ERROR", None, None, "y.jpg") and got["2"].notes.endswith("manually. no picture")
    assert got["3"].notes.startswith("Tag number is unclear")
    s = report.summary(out).first()
    assert (s.errors, s.ok) == (1, 2)
    assert quarantine.results(rows.limit(0)).count() == 0
