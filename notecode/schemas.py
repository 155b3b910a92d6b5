"""Declared schemas of the tables the toolkit reads and writes."""

from pyspark.sql import types as T

NOTE = T.StructType(
    [
        T.StructField("note_id", T.LongType()),
        T.StructField("note_text", T.StringType()),
        T.StructField("dp", T.StringType()),
        T.StructField("das", T.ArrayType(T.StringType())),
        T.StructField("mdp", T.StringType()),
    ]
)
NOTE_DP = T.StructType([NOTE["note_id"], NOTE["note_text"], NOTE["dp"]])
NOTE_DAS = T.StructType([NOTE["note_id"], NOTE["note_text"], NOTE["das"]])

REFERENTIAL = T.StructType(
    [
        T.StructField("ordinal", T.LongType()),
        T.StructField("code", T.StringType()),
        T.StructField("definition", T.StringType()),
        T.StructField("mco_had", T.DoubleType()),
    ]
)

PATIENT = T.StructType(
    [
        T.StructField("patient_id", T.LongType()),
        T.StructField("pool", T.StringType()),
        T.StructField(
            "documents",
            T.ArrayType(
                T.StructType(
                    [T.StructField("type", T.StringType()), T.StructField("text", T.StringType())]
                )
            ),
        ),
        T.StructField(
            "structured_abstract",
            T.StructType(
                [
                    T.StructField(
                        "primary_diagnosis",
                        T.ArrayType(T.StructType([T.StructField("code", T.StringType())])),
                    )
                ]
            ),
        ),
    ]
)

SYNONYM = T.StructType(
    [T.StructField("code", T.StringType()), T.StructField("libelle", T.StringType())]
)

LABEL_SPACE = T.StructType(
    [
        T.StructField("head", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("label_id", T.IntegerType()),
    ]
)
LABEL_FREQUENCY = T.StructType(
    [
        T.StructField("head", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("n", T.LongType()),
    ]
)
