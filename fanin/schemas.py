"""Declared schemas (never inferred) for the inputs and outputs of the operators."""

from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _st(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


REQUESTS = _st(("query_id", S, False), ("query", S, True), ("num_results", S, True),
               ("max_content_length", S, True), ("time_range", S, True))

RESULT_ITEM_A = _st(("url", S, True), ("title", S, True), ("content", S, True),
                    ("engines", T.ArrayType(S), True), ("score", D, True), ("published_us", L, True))

# One recorded result page: the items in order, as the source returned them.
RESULT_PAGES = _st(("query_id", S, False), ("source", S, False), ("page_no", I, False),
                   ("items", T.ArrayType(RESULT_ITEM_A), True))

RAW_B = _st(("query_id", S, False), ("pos", I, False), ("href", S, True), ("url", S, True),
            ("title", S, True), ("body", S, True), ("published_us", L, True))

RESULTS = _st(("query_id", S, False), ("source", S, False), ("raw_rank", I, False), ("href", S, False),
              ("title", S, False), ("body", S, False), ("engines", T.ArrayType(S), False),
              ("score", D, False), ("published_us", L, True))

SOURCE_OUTCOMES = _st(("query_id", S, False), ("source", S, False), ("outcome", S, False), ("error", S, True))

CAPTURES = _st(("url", S, False), ("tier", S, False), ("status", I, True), ("content_type", S, True),
               ("html", S, True), ("body", T.BinaryType(), True), ("error", S, True),
               ("captured_at", L, True), ("cut_len", I, True))

PDF_PAGES = _st(("url", S, False), ("page_no", I, False), ("text", S, True))

PAGES_RESOLVED = _st(("url", S, False), ("status", I, False), ("title", S, False), ("content", S, False),
                     ("content_length", L, False), ("method", S, True), ("error", S, True))

MEMO = _st(("key", S, False), ("ts_us", L, True), ("status", I, True), ("title", S, True),
           ("content", S, True), ("content_length", L, True), ("method", S, True), ("error", S, True))

ATTEMPTS = _st(("event_id", L, False), ("source", S, False), ("ts_us", L, False), ("ok", B, False))

REPORT_ROW = _st(("query_id", S, False), ("rank", L, False), ("title", S, False), ("url", S, False),
                 ("snippet", S, False), ("source", S, False), ("published_us", L, True), ("status", I, False),
                 ("fetch_method", S, True), ("cached", B, False), ("content_length", L, False),
                 ("content", S, False), ("error", S, True))
