"""Types and names of the data contract."""

from __future__ import annotations

from pyspark.sql import types as T

# Key names of the exchange format
METRIC, SYNONYMS, GROUP = "Nyckeltal", "Alternativa benämningar", "Grupp"
VALUE, SOURCE, CERTAINTY, COMMENT = "värde", "källa", "säkerhet", "kommentar"
PAGE = "Sida"
OFFICIAL_NAME, SHORT_NAME, FUND_NO = "Officiellt namn", "Kort namn", "KassaNummer"
OTHER_GROUP = "🧩 Övrigt"
SOURCE_HEADER = "⬅️ källa"

FINDING_STRUCT = T.StructType([T.StructField(VALUE, T.StringType()), T.StructField(SOURCE, T.StringType()), T.StructField(CERTAINTY, T.DoubleType()), T.StructField(COMMENT, T.StringType())])
#: fund -> year -> metric -> finding
TREE = T.MapType(T.StringType(), T.MapType(T.StringType(), T.MapType(T.StringType(), FINDING_STRUCT)))

PAGES = "doc_id string, page_no int, text string"
METRIC_DEFS = "ord int, metric string, synonyms array<string>, description string, formula string, grp string, instructions string"
FUNDS = "short_name string, official_name string, fund_no int"
#: the fields of a finding, each merged on its own
FIELDS = ("value", "source", "certainty", "comment")
