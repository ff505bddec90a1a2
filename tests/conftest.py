import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from factsieve import schemas, settings  # noqa: E402
from factsieve.operators import examples as ex  # noqa: E402
from factsieve.session import local_session  # noqa: E402

COMPANIES = [  # group, name, year, seat, head, product, trade
    ("G001", "Quillwork Mill", "1911", "Ghent", "Ora Finch", "Featherstock", "Stationery"),
    ("G002", "Juniper Ferries", "1958", "Kiel", "Mina Falk", "Skiff Nine", "Boating"),
    ("G003", "Juniper Orchards", "1972", "Porto", "Tomas Vey", "Press Crate", "Fruit"),
    ("G004", "Oat Lane Envelopes", "1934", "Turin", "Luis Prado", "Windowfold", "Stationery"),
    ("G005", "Brightwater Inks", "1958", "Ghent", "Mina Falk", "Night Blue", "Stationery"),
    ("G006", "Salt Road Carriers", "1980", "Kiel", "Ida Brandt", "Press Crate", "Haulage"),
]
PERSONS = [  # group, name, town, school, employer, work, employer before
    ("G101", "Petra Nunn", "Lima", "Leiden", "Oat Lane Envelopes", "Binder", "Juniper Cooperage"),
    ("G102", "Sol Abara", "Lima", "Pisa", "Juniper Cooperage", "Binder", "Old Quay"),
    ("G103", "Bo Ilves", "Cork", "Leiden", "Juniper Ferries", "Pilot", "Old Quay"),
    ("G104", "Rhea Toft", "Riga", "Evora", "Salt Road Carriers", "Porter", "Old Quay"),
]


def fact_rows(companies=COMPANIES, persons=PERSONS):
    rows, n = [], 0
    for kind, people in (("company", companies), ("person", persons)):
        names = [s.attribute for s in settings.specs(kind)]
        for gid, entity, *values in people:
            for attribute, value in zip(names, values):
                n += 1
                rows.append((f"F{n:03d}", gid, entity, kind, attribute, value, f"{entity} {attribute} {value}."))
    return rows


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests", 4)


@pytest.fixture(scope="session")
def facts(spark):
    return spark.createDataFrame(fact_rows(), schemas.FACTS).cache()


@pytest.fixture(scope="session")
def corpus(spark, facts):
    """All groups in train, so that every record is there to be targeted."""
    from pyspark.sql import functions as F

    return ex.build_examples(facts.withColumn("split", F.lit("train"))).cache()
