"""factsieve: fact-table corpora, erasure targeting and erasure audits as Spark DataFrame jobs."""
