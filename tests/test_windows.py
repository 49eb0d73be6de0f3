"""Words and their edges beside letters outside ASCII, as in the SQL."""

import duckdb
import pandas as pd
import pytest

from siftline.functions import text as tx
from siftline.operators import windows
from siftline.plans import window_queries  # noqa: F401  registers TXT-27
from siftline.plans.registry import ORACLES


def test_words_that_point_back_end_at_letters_outside_ascii(spark):
    texts = ["first", "dasßen es", "übereit", "une pièce", "daś", "theſe", "thiſ", "thiſa", "it's", "edit", "_it", "İt", "eso", None, "das٠", "so it"]
    rows = [(c, t, "user", text) for c, one in enumerate(texts) for t, text in enumerate(["before", one])]
    got = {(r.conv_id, r.turn, r.query) for r in windows.followup_query(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    connection = duckdb.connect()
    connection.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    want = set(connection.execute(ORACLES["TXT-27"]).fetchall())
    assert got == want and (1, 1, "dasßen es\nbefore") in got


@pytest.mark.parametrize("message", ["ésk-abcdefgh1", "sk-abcdefgh1é", "xsk-abcdefgh1", "sk-abcdefgh-", "sk-abcdefg"])
def test_keys_beside_letters_outside_ascii(spark, message):
    got = spark.createDataFrame([(message,)], "m string").select(tx.redact_secrets("m").alias("m")).first().m
    assert got == duckdb.execute(r"SELECT regexp_replace(?, '\bsk-[A-Za-z0-9_-]{8,}\b', '[REDACTED]', 'g')", [message]).fetchone()[0]
