import pytest

from docsafe import settings
from docsafe.functions.readings import Floors
from docsafe.sources import scripts


def test_defaults_and_floors():
    got = settings.read(None, {}, "/nowhere")
    assert got["max_pages"] == 5000 and got["hallucination_guard_suffix_only"] is True and isinstance(got["recognition_batch_width_ratio"], float)
    assert settings.floors(got) == Floors()


def test_order_of_sources(spark, tmp_path):
    file = tmp_path / ".env"
    file.write_text("# note\nDOCSAFE_MAX_PAGES=7\nexport DOCSAFE_SEAM_MAX_CHAR_OVERLAP = '9'\nDOCSAFE_MAX_BEAM_RETRIES_PER_PAGE=3 # three\nOTHER=1\nnonsense\n")
    got = settings.read(None, {"docsafe_max_pages": "8"}, file)
    assert (got["max_pages"], got["seam_max_char_overlap"], got["max_beam_retries_per_page"]) == (8, 9, 3)
    spark.conf.set("spark.docsafe.max_pages", "9")
    try:
        assert settings.read(spark, {"DOCSAFE_MAX_PAGES": "8"}, file)["max_pages"] == 9
    finally:
        spark.conf.unset("spark.docsafe.max_pages")


@pytest.mark.parametrize("name, value", [("MAX_PAGES", "0"), ("MAX_PAGES", "many"), ("SEAM_MAX_CHAR_OVERLAP", "129"), ("RECOGNITION_BATCH_WIDTH_RATIO", "nan"), ("DECODER_EVIDENCE_FULL_COVERAGE", "perhaps")])
def test_bounds(name, value):
    with pytest.raises(ValueError, match=name.lower()):
        settings.read(None, {f"DOCSAFE_{name}": value}, "/nowhere")


def test_scripts(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.py").write_text("'''doc\nmore'''\nx = f\"a{1}b\" + 'é'\n")
    (tmp_path / "deep" / "b.py").write_text("def (:")
    (tmp_path / "c.py").write_bytes(b"x = '\xff'")
    (tmp_path / "d.txt").write_text("x = 'no'")
    (tmp_path / "e.py").write_text("x = '\\ud800'")
    got = scripts.string_literals(scripts.scripts(spark, str(tmp_path))).collect()
    assert sorted((r["path"][-4:], r["line"], r["value"]) for r in got) == [("a.py", 1, "doc\nmore"), ("a.py", 3, "a"), ("a.py", 3, "b"), ("a.py", 3, "é"), ("e.py", 1, "?")]
