"""The catalogue data source over folders of stored answers."""

import json

from tessera.plans import catalogues
from tessera.sources import catalogue


def store(folder, pages):
    for number, body in pages.items():
        (folder / f"page={number}").mkdir(parents=True)
        (folder / f"page={number}" / "part-0.txt").write_text(body if isinstance(body, str) else json.dumps(body))
    return str(folder)


def test_pages_errors_and_refusals(spark, tmp_path):
    folder = store(tmp_path / "c", {1: {"items": [{"id": 1, "title": " A  b ", "description": "d", "company": "o"}, {"id": 2, "title": "x", "detail_status": 403}, {"rcn": 3, "title": "y", "detail_status": 500}, {"id": 4}]}, 2: '{"items": [', 3: "[]", 4: {"items": None}})
    rows = {(r.page, r.external_id): r for r in catalogue.read(spark, folder, pages_per_partition=1).collect()}
    assert set(rows) == {(1, "1"), (1, "2"), (1, "3"), (1, "4"), (2, None), (3, None)}
    one = rows[1, "1"]
    assert (one.title, one.summary, one.organisation, one.status, one.listing_only, one.error, one.url) == ("A b", "d", "o", 200, False, None, "https://c.example/1")
    assert rows[1, "2"].listing_only and rows[1, "2"].error is None and rows[1, "3"].error == "HTTP 500" and rows[1, "4"].error == "record has no title"
    assert rows[2, None].error == "unreadable page: JSONDecodeError" and rows[3, None].error == "unreadable page: ValueError"


def test_styles_and_requests(spark, tmp_path):
    folder = store(tmp_path / "c", {n: {"items": [{"id": n, "title": "t"}], "next": {1: 3, 3: "2", 2: 1}.get(n)} for n in (1, 2, 3, 4)})
    ask = lambda **o: {r.page: r.request for r in catalogue.read(spark, folder, size=10, **o).collect()}
    assert ask(style="cursor").keys() == {1, 2, 3}  # the chain turns back and ends
    assert ask(style="offset")[3].endswith("from=20&count=10") and ask(style="page")[4].endswith("p=4&num=10")
    assert json.loads(ask(method="post")[2])["pagination"] == {"page": 2, "size": 10}


def test_only_wanted_pages_are_opened(spark, tmp_path):
    folder = store(tmp_path / "c", {n: {"items": [{"id": n, "title": "t"}]} for n in range(1, 41)})
    assert catalogue.read(spark, folder, pages_per_partition=4).rdd.getNumPartitions() == 10
    some = catalogue.read(spark, folder, pages_per_partition=4, first_page=11, last_page=16)
    assert sorted(r.page for r in some.collect()) == list(range(11, 17)) and some.rdd.getNumPartitions() == 2
    whole = catalogue.read(spark, folder)
    assert sorted(r.page for r in whole.where("page < 3").unionByName(whole.where("page > 38")).collect()) == [1, 2, 39, 40]


def test_no_folder_is_an_empty_catalogue(spark, tmp_path):
    assert catalogue.read(spark, str(tmp_path / "none")).isEmpty()


def test_answers_are_stored_once(spark, sf):
    assert catalogues.answers(spark, sf) == catalogues.answers(spark, sf)
