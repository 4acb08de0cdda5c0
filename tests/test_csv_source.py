"""CSV files read by their headers: order, missing and further columns, broken records, quotes, several files."""

from __future__ import annotations

import pytest

from holdfast.sources.schema import SCHEMAS
from holdfast.sources.tables import broken_records, csv_records, read_tables, unreadable, write_table

TICKET = {
    "ticket_id": "7", "customer_id": "70", "ticket_date": "2000-01-02", "issue_type": "Billing", "resolution_time_hours": "1.5",
    "satisfaction_score": "4", "ticket_status": "Closed",
}
NAMES = SCHEMAS["support_tickets"].names


def put(folder, header, *lines, name="support_tickets"):
    folder.mkdir(exist_ok=True, parents=True)
    (folder / f"{name}.csv").write_text("\n".join([",".join(header), *lines]) + "\n")
    return str(folder)


def line(names, **other) -> str:
    return ",".join({**TICKET, **other}.get(c, "") for c in names)


def rows(spark, folder, **how):
    return [(r["ticket_id"], r["customer_id"], r["issue_type"], r["satisfaction_score"], r["ticket_status"]) for r in read_tables(spark, folder, **how).tickets.collect()]


def test_columns_in_another_order(spark, tmp_path):
    names = NAMES[::-1]
    folder = put(tmp_path / "raw", names, line(names), line(names, ticket_id="8"))
    assert sorted(rows(spark, folder)) == [(7, 70, "Billing", 4, "Closed"), (8, 70, "Billing", 4, "Closed")]
    assert read_tables(spark, folder).tickets.schema == SCHEMAS["support_tickets"]


def test_two_numbers_swapped(spark, tmp_path):
    names = [NAMES[1], NAMES[0], *NAMES[2:]]
    assert rows(spark, put(tmp_path / "raw", names, line(names))) == [(7, 70, "Billing", 4, "Closed")]


def test_further_columns_are_passed_over(spark, tmp_path):
    names = ["agent", *NAMES[:3], "note.of day", *NAMES[3:]]
    folder = put(tmp_path / "raw", names, line(names, agent="x", **{"note.of day": "9"}))
    assert rows(spark, folder) == [(7, 70, "Billing", 4, "Closed")]
    assert read_tables(spark, folder).tickets.columns == NAMES


def test_header_in_capitals_with_blanks_and_byte_order_mark(spark, tmp_path):
    folder = put(tmp_path / "raw", ["﻿" + NAMES[0], *[f" {c.upper()} " for c in NAMES[1:]]], line(NAMES))
    assert rows(spark, folder) == [(7, 70, "Billing", 4, "Closed")]


@pytest.mark.parametrize("names", [[c for c in NAMES if c != "customer_id"], [*NAMES[:1], *NAMES[:1], *NAMES[2:]]])
def test_missing_column_is_an_error(spark, tmp_path, names):
    folder = put(tmp_path / "raw", names, line(names))
    with pytest.raises(ValueError, match="support_tickets: no column .*customer_id"):
        read_tables(spark, folder).tickets


def test_broken_records_are_left_out_and_counted(spark, tmp_path):
    long, short = line(NAMES, issue_type="Billing, late", ticket_id="8"), "9,90,2000-01-02,Billing"
    folder = put(tmp_path / "raw", NAMES, line(NAMES), long, short, line(NAMES, ticket_id="10", issue_type='"Billing, ""late"""'))
    expected = [(7, 70, "Billing", 4, "Closed"), (10, 70, 'Billing, "late"', 4, "Closed")]
    assert sorted(rows(spark, folder)) == expected
    # whatever columns a plan needs
    t = read_tables(spark, folder).tickets
    assert t.count() == 2 and sorted(r[0] for r in t.select("ticket_id").collect()) == [7, 10]
    for name in SCHEMAS:
        if name != "support_tickets":
            put(tmp_path / "raw", SCHEMAS[name].names, name=name)
    got = {r["table_name"]: (r["records"], r["broken"], r["example"]) for r in broken_records(spark, folder).collect()}
    assert got.pop("support_tickets") == (4, 2, min(long, short)) and set(got.values()) == {(0, 0, None)}
    assert unreadable(spark, folder).collect() == []
    assert csv_records(spark, folder, "support_tickets").count() == 4


def test_files_with_different_headers(spark, tmp_path):
    folder = tmp_path / "raw" / "support_tickets.csv"
    folder.mkdir(parents=True)
    swapped = [NAMES[1], NAMES[0], *NAMES[2:]]
    for part, names, ticket in (("a", NAMES, "1"), ("b", swapped, "2"), ("c", [*NAMES, "extra"], "3")):
        (folder / f"part-{part}.csv").write_text(",".join(names) + "\n" + line(names, ticket_id=ticket) + "\n")
    # by position customer and ticket would be exchanged: the read fails instead
    with pytest.raises(Exception, match="(?i)header"):
        read_tables(spark, str(tmp_path / "raw")).tickets.collect()
    assert sorted(rows(spark, str(tmp_path / "raw"), mixed_headers=True)) == [(k, 70, "Billing", 4, "Closed") for k in (1, 2, 3)]


def test_line_breaks_inside_quotes(spark, tmp_path):
    folder = put(tmp_path / "raw", NAMES, line(NAMES, issue_type='"Billing\nagain"'), line(NAMES, ticket_id="8"))
    assert sorted(rows(spark, folder, multiline=True)) == [(7, 70, "Billing\nagain", 4, "Closed"), (8, 70, "Billing", 4, "Closed")]


def test_written_quotes_come_back(spark, tmp_path):
    folder = put(tmp_path / "raw", NAMES, line(NAMES, issue_type='"a ""b"", c"'))
    t = read_tables(spark, folder).tickets
    write_table(t, f"{tmp_path}/out/support_tickets.csv", "csv")
    assert rows(spark, f"{tmp_path}/out") == rows(spark, folder) == [(7, 70, 'a "b", c', 4, "Closed")]


def test_file_order_by_header(spark, tmp_path):
    names = SCHEMAS["customers"].names[::-1]
    records = [{"customer_id": str(k % 50), "signup_date": "2000-01-01", "age": str(20 + k // 50)} for k in range(100)]
    folder = put(tmp_path / "raw", names, *[",".join(r.get(c, "") for c in names) for r in records], name="customers")
    t = read_tables(spark, folder, ingest_order=True).customers
    first = t.orderBy("ingest_ord").collect()
    assert [(r["customer_id"], r["age"]) for r in first] == [(k % 50, 20 + k // 50) for k in range(100)]
