"""Explicit schemas of the tables the operators read and write."""

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
ROI = T.StructType([T.StructField(n, T.IntegerType()) for n in ("x1", "y1", "x2", "y2")])

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("case_id", T.LongType()),
    T.StructField("doc_type", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("mime", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("requested_fields", T.StringType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
])

OCR_LINES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("read_id", T.LongType()),
    T.StructField("line_no", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("box", T.ArrayType(POINT)),
])

OCR_READS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("field", T.StringType()),
    T.StructField("roi_ordinal", T.IntegerType()),
    T.StructField("variant", T.StringType()),
    T.StructField("detect_text", T.BooleanType()),
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("line_idx", T.IntegerType()),
    T.StructField("raw_text", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])

BOX_READS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("box_set", T.IntegerType()),
    T.StructField("box_idx", T.IntegerType()),
    T.StructField("ordinal", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("raw_text", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])

BANK_ACCOUNTS = T.StructType([
    T.StructField("account_number", T.StringType()),
    T.StructField("account_holder_name", T.StringType()),
    T.StructField("signature_reference_path", T.StringType()),
])

ROI_TEMPLATES = T.StructType([
    T.StructField("template_id", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("x1", T.DoubleType()),
    T.StructField("y1", T.DoubleType()),
    T.StructField("x2", T.DoubleType()),
    T.StructField("y2", T.DoubleType()),
])

PROFILE_JSON = T.StructType([
    T.StructField("full_name", T.StringType()),
    T.StructField("dob", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("father_name", T.StringType()),
    T.StructField("location", T.StructType([
        T.StructField(n, T.StringType()) for n in ("state", "pincode", "country")
    ])),
    T.StructField("address_details", T.StructType(
        [T.StructField(n, T.StringType()) for n in (
            "full_address", "raw_text", "city", "district", "town_or_city", "address_line_1",
            "village", "street_or_post_office", "area_or_locality")]
        + [T.StructField("lines", T.ArrayType(T.StringType()))]
    )),
    T.StructField("confidence_metrics", T.MapType(T.StringType(), T.StructType([
        T.StructField("score_percentage", T.DoubleType()),
        T.StructField("needs_review", T.BooleanType()),
    ]))),
    T.StructField("raw_extracted_text", T.MapType(T.StringType(), T.StringType())),
])
