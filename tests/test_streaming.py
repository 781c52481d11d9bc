import json

from hazardlens.session import new_folder
from hazardlens.streaming.arrivals import stored_rows, take_in, unreadable_texts


def document(osv_id, *names):
    return json.dumps({"id": osv_id, "affected": [{"package": {"name": name, "ecosystem": "npm"}} for name in names]})


def test_each_document_is_taken_once(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    table, progress = new_folder(spark, "table"), new_folder(spark, "progress")

    def ids():
        take_in(spark, str(inbox), table, progress)
        return sorted((row["osv_id"], row["package_name"]) for row in stored_rows(spark, table).collect())

    (inbox / "1.txt").write_text("\n".join([document("A", "x", "y"), document("B", "x"), "{broken"]))
    first = ids()
    assert first == [("A", "x"), ("A", "y"), ("B", "x")]
    assert ids() == first
    (inbox / "2.txt").write_text("\n".join([document("A", "z"), document("C", "w"), document("C", "w")]))
    assert ids() == first + [("C", "w")]
    assert ids() == first + [("C", "w")]
    assert [row["document"] for row in unreadable_texts(spark, table).collect()] == ["{broken"]


def test_whole_files_and_the_latest_version(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    table, progress = new_folder(spark, "table"), new_folder(spark, "progress")
    for file, name, modified in [("1", "old", "2020-01-01T00:00:00Z"), ("2", "new", "2021-01-01T00:00:00Z")]:
        (inbox / f"{file}.json").write_text(json.dumps({**json.loads(document("A", name)), "modified": modified}, indent=2))
    (inbox / "3.json").write_text(document("B", "x"))
    (inbox / "4.json").write_text("{\n broken")
    take_in(spark, str(inbox), table, progress, one_per_file=True)
    assert sorted((row["osv_id"], row["package_name"]) for row in stored_rows(spark, table).collect()) == [("A", "new"), ("B", "x")]
    assert unreadable_texts(spark, table).count() == 1


def test_a_batch_looks_up_its_own_ids_only(spark, tmp_path):
    """The state knows all earlier ids; the plan of a batch has no scan of what was stored."""
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    table, progress = new_folder(spark, "table"), new_folder(spark, "progress")
    lookups, known = [], []
    for call in range(3):
        ids = [f"{call}-{i}" for i in range(400)]
        (inbox / f"{call}.txt").write_text("\n".join(document(i, "x") for i in [*ids, *(["0-0", "0-1"] if call else [])]))
        report = [p for p in take_in(spark, str(inbox), table, progress) if p["numInputRows"]]
        assert [p["numInputRows"] for p in report] == [402 if call else 400]  # the batch is read and parsed once
        state = report[0]["stateOperators"][0]
        lookups.append(state["customMetrics"]["rocksdbGetCount"])
        known.append(state["numRowsTotal"])
    assert known == [400, 800, 1200]
    assert max(lookups) <= 3 * min(lookups)  # they follow the batch, not the history
    assert stored_rows(spark, table).count() == 1200


def test_empty_documents_do_not_make_an_id_known(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    table, progress = new_folder(spark, "table"), new_folder(spark, "progress")
    (inbox / "1.txt").write_text(json.dumps({"id": "A", "modified": "2021-01-01T00:00:00Z"}) + "\n" + document("A", "old") + "\n{bad")
    take_in(spark, str(inbox), table, progress)
    assert stored_rows(spark, table).count() == 0  # the last version has no entry
    (inbox / "2.txt").write_text(document("A", "new", "new") + "\n{bad\n" + document("B"))
    take_in(spark, str(inbox), table, progress)
    assert [row["package_name"] for row in stored_rows(spark, table).collect()] == ["new", "new"]
    assert [row["batch"] for row in unreadable_texts(spark, table).orderBy("batch").collect()] == [0, 1]
