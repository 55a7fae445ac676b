"""A registry read from a file."""

import json

import pytest

from tessera.sources.pages import read_registry

GOOD = [{"id": "a", "homepage": "https://a.example", "adapter": "html", "collection_url": "https://a.example/list", "enabled": False}, {"id": "b", "homepage": "http://b.example", "adapter": "json", "collection_url": None, "tags": ["x"]}]


def test_yaml_and_json(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text("sources:\n- id: a\n  homepage: https://a.example\n  adapter: html\n  collection_url: https://a.example/list\n  enabled: false\n- {id: b, homepage: 'http://b.example', adapter: json, collection_url: null, tags: [x]}\n")
    (tmp_path / "r.json").write_text(json.dumps({"sources": GOOD}))
    rows = [sorted(map(tuple, read_registry(spark, str(tmp_path / f)).collect())) for f in ("r.yaml", "r.json")]
    assert rows[0] == rows[1] and [r[:5] for r in rows[0]] == [("a", "https://a.example", "html", "https://a.example/list", False), ("b", "http://b.example", "json", None, True)]


@pytest.mark.parametrize("document", [{}, {"sources": {}}, [], {"sources": [{**GOOD[0], "id": ""}]}, {"sources": [GOOD[0], GOOD[0]]}, {"sources": [{**GOOD[0], "collection_url": "ftp://x"}]}, {"sources": [{**GOOD[0], "homepage": "nowhere"}]}, {"sources": [{"id": "a", "homepage": "https://x.example"}]}])
def test_bad_registries(spark, tmp_path, document):
    (tmp_path / "r.json").write_text(json.dumps(document))
    with pytest.raises(ValueError):
        read_registry(spark, str(tmp_path / "r.json"))


def test_an_empty_registry(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"sources": []}')
    assert read_registry(spark, str(tmp_path / "r.json")).isEmpty()
