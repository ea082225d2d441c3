"""Queries by name, each with the SQL that states the same result independently."""

from dataclasses import dataclass

from .fixtures import fixture, fixture_ctes

QUERIES, ORACLES, COVERS = {}, {}, {}


@dataclass
class Inputs:
    """Tables of one data folder, built when asked for."""

    spark: object
    sf_dir: str

    def __getattr__(self, name):
        return fixture(self.spark, self.sf_dir, name)

    def large(self, name):
        """The table joined in an order for inputs of which none fits into a broadcast."""
        return fixture(self.spark, self.sf_dir, name, large=True)


def sql_with(tables, select, ctes=(), recursive=False):
    """A statement over derived tables and further named subqueries."""
    entries = [*fixture_ctes(*tables), *ctes]
    word = "WITH RECURSIVE" if recursive else "WITH"
    return f"{word} " + ",\n".join(entries) + f"\n{select}"


def query(name, covers, sql=None):
    """Registers `build(inputs) -> DataFrame` under a name."""
    def register(build):
        QUERIES[name] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
        COVERS[name] = tuple(covers.split())
        if sql:
            ORACLES[name] = sql
        return build
    return register
