import json

import pytest

from vaultlens.operators.spans import Settings
from vaultlens.plans.scan import FILES, scan

CASES = {
    # name: (rel_path, format, header, rows, chunks) -> (storage class, level, a reason)
    "form": (("hr/anketa.txt", "txt", [], 0, ["Анкета. ФИО: Иванов Иван Иванович | СНИЛС 112-233-445 95 | Телефон: +7 (999) 123-45-67"]), ("TARGET_LEAK", "UZ-3", "LEAK_GOVERNMENT_PRESENT")),
    "template": (("hr/blank.txt", "txt", [], 0, ["Full name: ______ Address: ______ Passport: ______ Phone: ______"]), ("NON_TARGET", "NO_PDN", "TEMPLATE_PLACEHOLDER_FIELDS")),
    "policy": (("site/policy.txt", "txt", [], 0, ["Privacy policy, terms and cookies. Write to a@b.org"]), ("PD_BUT_JUSTIFIED_STORAGE", "NO_PDN", "PUBLIC_DOC_KEYWORDS")),
    "web": (("w/x.html", "html", [], 0, ["follow us telegram twitter rss Full name: Bob Marsh email q@w.org"]), ("NON_TARGET", "NO_PDN", "SUPPRESSED_HTML_NOISE:email")),
    "export": (("Billing/customers.parquet", "parquet", ["customer_name", "address"], 1, ["customer_name: Alice Monroe | address: 12 High Street, Springfield | snils: 11223344595"]), ("TARGET_LEAK", "UZ-3", "LEAK_CONTEXT_PERSONAL_EXPORT")),
    "health": (("cards/health.txt", "txt", [], 0, ["Заявление. ФИО: Иванов Иван Иванович | диагноз: астма"]), ("TARGET_LEAK", "UZ-1", "LEAK_SPECIAL_OR_BIOMETRIC")),
    "card": (("payments/pay.txt", "txt", [], 0, ["application: card 4111 1111 1111 1111"]), ("TARGET_LEAK", "UZ-2", "LEAK_VALIDATED_PAYMENT")),
    "catalog": (("products/plans.csv", "csv", ["id", "code"], 2, ["id: 7 | code: 5 | status: new", "id: 8 | code: 6 | status: old"]), ("NON_TARGET", "NO_PDN", "REFERENCE_DATA_PATH")),
    "docx": (("docs/other.docx", "docx", [], 0, ["write to a@b.org"]), ("NON_TARGET", "NO_PDN", "DOCX_PATH_NOT_SHORTLISTED")),
    "video": (("v.mp4", "mp4", [], 0, []), ("NON_TARGET", "NO_PDN", "LEAK_CONTEXT_NO_PERSONAL_SIGNAL")),
    "weak": (("kadry/mail.txt", "txt", [], 0, ["сотрудник: a@b.org сообщение"]), (None, "NO_PDN", None)),
}


@pytest.fixture(scope="module")
def done(spark):
    files = [(k, v[0][0], v[0][1], v[0][1], v[0][2], v[0][3], 1, "unsupported" if v[0][1] == "mp4" else "ok", []) for k, v in CASES.items()]
    chunks = [(k, i, c) for k, v in CASES.items() for i, c in enumerate(v[0][4])]
    out = scan(spark.createDataFrame(files, FILES), spark.createDataFrame(chunks, "file_id string, raw_idx int, text string"), Settings())
    return {r["file_id"]: r for r in out.collect()}


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(done, name):
    cls, level, reason = CASES[name][1]
    row = done[name]
    assert row["level"] == level, row
    assert cls is None or row["storage_class"] == cls, row
    assert reason is None or reason in row["reasons"], row


def test_empty_scan(spark):
    out = scan(spark.createDataFrame([], FILES), spark.createDataFrame([], "file_id string, raw_idx int, text string"))
    assert out.collect() == []


def test_directory_scan_shows_no_raw_values(spark, tmp_path):
    from vaultlens.cli import Config, run_scan

    (tmp_path / "in/hr").mkdir(parents=True)
    (tmp_path / "in/.git").mkdir()
    (tmp_path / "in/.git/x.txt").write_text("a@b.org")
    (tmp_path / "in/hr/a.txt").write_text("Анкета. ФИО: Иванов Иван Иванович, email: secret@host.org, карта 4111 1111 1111 1111", encoding="utf-8")
    (tmp_path / "in/hr/b.json").write_text("{not json")
    out = str(tmp_path / "out")
    assert run_scan(spark, str(tmp_path / "in"), out, Config()) == ["summary.csv", "result.csv", "report.json", "report.md"]
    for name in ("summary.csv", "result.csv", "report.json", "report.md"):
        text = open(f"{out}/{name}", encoding="utf-8").read()
        assert "secret@host.org" not in text and "4111 1111 1111 1111" not in text and "иванов иван" not in text.lower()
    report = json.load(open(f"{out}/report.json", encoding="utf-8"))
    assert {f["rel_path"] for f in report["files"]} == {"hr/a.txt", "hr/b.json"}
    assert report["summary"]["totals"]["files"] == {"processed": 2, "with_detections": 1, "with_errors": 1}


def test_config(tmp_path):
    from vaultlens.cli import load_config, main

    path = tmp_path / "c.yaml"
    path.write_text('{"detection": {"context_window": 40}, "uz_thresholds": {"ordinary_large_unique": 3}}')
    config = load_config(str(path))
    assert config.settings().context == 40 and config.thresholds().ordinary == (3, 100, 50)
    path.write_text('{"detection": {"nothing": 1}}')
    with pytest.raises(ValueError):
        load_config(str(path))
    assert main(["version"]) == 0
