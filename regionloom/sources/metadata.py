"""Field descriptions, documentation addresses and source keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from regionloom.functions.scalars import as_col

# Fixed value: the parts read from a metadata document.
DOCUMENT_SCHEMA = (
    "fields array<struct<name:string,alias:string>>, "
    "columns array<struct<fieldName:string,name:string,description:string>>"
)


def field_dictionary_of(documents: DataFrame, source_key: Column | str = "source_key") -> DataFrame:
    """(source_key, field_name, description) from documents with ``fields`` or ``columns`` arrays."""
    key = as_col(source_key).alias("source_key")
    from_fields = F.transform(
        "fields", lambda f: F.struct(f["name"].alias("field_name"), f["alias"].alias("description"))
    )
    from_columns = F.transform(
        "columns",
        lambda c: F.struct(
            F.coalesce(c["fieldName"], c["name"]).alias("field_name"), c["description"].alias("description")
        ),
    )
    both = F.concat(F.coalesce(from_fields, F.array()), F.coalesce(from_columns, F.array()))
    rows = documents.select(key, F.inline(both))
    return rows.where(F.col("field_name").isNotNull() & F.col("description").isNotNull())


def field_dictionary(spark: SparkSession, paths) -> DataFrame:
    """The same from JSON files; the key is the file stem."""
    documents = (
        spark.read.schema(DOCUMENT_SCHEMA)
        .option("multiLine", True)
        .json(paths)
        .withColumn("source_key", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1))
    )
    return field_dictionary_of(documents)


def metadata_url(url, connector_type) -> Column:
    """Documentation address from the address and the kind of a source."""
    url, kind = as_col(url), as_col(connector_type)
    low = F.lower(url)
    # fixed values: kinds of sources and the address forms of the services that answer them
    open_data = (kind == "csv") & (low.contains("socrata") | low.contains("data.oregon.gov"))
    resource = r"^(.+)/resource/([a-zA-Z0-9\-]+)\.csv"
    doi = r"doi\.org/(.+)"
    research = (kind == "research_ref") | url.contains("figshare")
    return (
        F.when(
            open_data & url.rlike(resource),
            F.concat(
                F.regexp_extract(url, resource, 1), F.lit("/api/views/"), F.regexp_extract(url, resource, 2), F.lit(".json")
            ),
        )
        .when(kind == "arcgis_rest", F.regexp_replace(url, r"/query.*$", "?f=pjson"))
        .when(research & url.contains("api.figshare.com"), url)
        .when(research & url.rlike(doi), F.concat(F.lit("https://api.datacite.org/works/"), F.regexp_extract(url, doi, 1)))
        .when(low.contains("zip"), F.concat(url, F.lit("#metadata_index")))
        .otherwise(url)
    )


# File name parts that name a source, tried in this order.
FILENAME_RULES = (
    ("slido", "portal_dogami_slido"),
    ("odf_firestats", "portal_odf_firestats"),
    ("ics", "portal_sci_data_ics209_demo"),
)


def source_key_from_filename(name, rules=FILENAME_RULES) -> Column:
    """Key of the first rule whose part occurs in the name, else the name without ``.csv``."""
    name = as_col(name)
    found = None
    for part, key in rules:
        hit = F.lower(name).contains(part)
        found = F.when(hit, key) if found is None else found.when(hit, key)
    return found.otherwise(F.regexp_replace(name, r"\.csv", ""))
