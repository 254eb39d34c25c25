"""Written cases with their results, for parsers whose work SQL can't express: the query works the texts out, the SQL states the results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CHATTER = (
    ("case:1", "Here is the transcription of the page:\n\n---\nQ1. Trace it", "Q1. Trace it"),
    ("case:2", "Q1. Here is a transcription of it", "Q1. Here is a transcription of it"),
    ("case:3", "Q1. Text\n### Handwritten notes:\n* left of Q3\n\n---\nQ2. More", "Q1. Text\nQ2. More"),
    ("case:4", "### Handwritten Notes:\n\n* a tick\n---\n1. Printed item\n2. Another", "1. Printed item\n2. Another"),
    ("case:5", "Sure! Below is the transcribed text.\n- printed list", "- printed list"),
)
PERSONAL = (
    ("case:1", "Name: Pel Vorrin\nRoll no. 7731204\nQ1. Name the tree\nName Pel Vorrin", "Q1. Name the tree\nName Pel Vorrin"),
    ("case:2", "Name: ________\nRoll no. ________\nQ1. x", "Name: ________\nRoll no. ________\nQ1. x"),
    ("case:3", "Student's name: Pel Vorrin  Enrolment No.: KX/2231\nTime: 2 hours", "Time: 2 hours"),
    ("case:4", "Q1. x\nRegistration Number: 7731 204 (by hand)\nroll_no = 5;", "Q1. x\nroll_no = 5;"),
)
HEADINGS = (
    ("case:1", "### Q.1\n\nQ1. Text", "\nQ1. Text"),
    ("case:2", "## Q2.\nText of two", "## Q2.\nText of two"),
    ("case:3", "## Q3\nQ4. x", "## Q3\nQ4. x"),
)
CALCULATIONS = (
    ("case:1", "so far: 2 + 3 * 4 = 14.", "2 + 3 * 4", "14", 14.0, True),
    ("case:2", "5 + 8 = 12", "5 + 8", "12", 13.0, False),
    ("case:3", "(7+8)/4 = 3", "(7 + 8) / 4", "3", 3.75, True),
    ("case:4", "10/3 = 3.33", "10 / 3", "3.33", 3.333333, True),
    ("case:5", "max(3, 2^3) = 8", "max(3, 2 ^ 3)", "8", 8.0, True),
    ("case:6", "17 % 5 = 3", "17 % 5", "3", 2.0, False),
)
NUMBERINGS = (("case:1", "1 2 3 12 4 5", "1 2 3 4 5"), ("case:2", "1 2 9 10", "1 2 9 10"), ("case:3", "1 2 3 1 2", "1 2 3 1 2"), ("case:4", "1 5", "1 5"), ("case:5", "3 1 1 2", "1 2"), ("case:6", "4 5 6", "4 5 6"))
OUTCOME_ROWS = (
    ("case:1", "| C311.2 | Use the semaphore to handle every page | Apply |\n| --- | --- | --- |\n| C311.4 | too short | Apply |", "C311.2", "Use the semaphore to handle every page"),
    ("case:2", "CO3 & Compare two ways of  keeping one quantum & Analyze \\\\", "CO3", "Compare two ways of keeping one quantum"),
)


def frame(spark: SparkSession, cases: tuple, schema: str) -> DataFrame:
    """The first columns of the cases, as many as the schema names."""
    n = len(schema.split(","))
    return spark.createDataFrame([c[:n] for c in cases], schema)


def values(cases: tuple, columns: tuple[int, ...], names: str) -> str:
    """A SELECT of some of the cases' columns."""
    def literal(v) -> str:
        return str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, float) else "'" + v.replace("'", "''") + "'"

    rows = ", ".join("(" + ", ".join(literal(c[i]) for i in columns) + ")" for c in cases)
    return f"SELECT * FROM (VALUES {rows}) t({names})"
