"""Only notes that count are made."""

from quillon import queries as clipboard


def test_messages_are_made_for_notes_that_count(spark, sf_dir):
    plan = clipboard.q_notes(spark, sf_dir)._jdf.queryExecution().analyzed().toString()
    assert "struct(note" in plan and "THEN struct(note" in plan and ".count > cast(0" not in plan
