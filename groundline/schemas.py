"""Tables of the engine. ``doc_seq`` names a document: ids can be null or repeat."""

from pyspark.sql import types as T

CHAR_INTERVAL = TOKEN_INTERVAL = T.StructType([T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())])

EXTRACTION = T.StructType(
    [
        T.StructField("extraction_class", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("attributes_json", T.StringType()),
        T.StructField("char_interval", CHAR_INTERVAL),
        T.StructField("token_interval", TOKEN_INTERVAL),
        T.StructField("alignment_status", T.StringType()),
        T.StructField("extraction_index", T.IntegerType()),
        T.StructField("group_id", T.StringType()),
        T.StructField("document_id", T.StringType()),
    ]
)
DOCUMENTS = T.StructType([T.StructField("doc_seq", T.LongType()), T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("metadata_json", T.StringType())])
ANNOTATED = T.StructType([*DOCUMENTS.fields, T.StructField("extractions", T.ArrayType(EXTRACTION))])
CHUNKS = T.StructType(
    [T.StructField("doc_seq", T.LongType()), T.StructField("chunk_index", T.IntegerType()), T.StructField("text", T.StringType())]
    + [T.StructField(c, T.IntegerType()) for c in ("start_pos", "end_pos", "tok_start", "tok_end")]
    + [T.StructField("document_id", T.StringType())]
)
MODEL_OUTPUTS = T.StructType([T.StructField("doc_seq", T.LongType()), T.StructField("chunk_index", T.IntegerType()), T.StructField("pass_index", T.IntegerType()), T.StructField("output_text", T.StringType())])
PARSED_ITEM = T.StructType([T.StructField(c, T.StringType()) for c in ("extraction_class", "text", "description", "attributes_json", "group_id")])
PARSED = T.StructType([T.StructField("items", T.ArrayType(PARSED_ITEM)), T.StructField("parse_error", T.StringType())])

STATUSES = ("exact", "fuzzy", "ungrounded", "overlap", "error")
