"""shelfmark: book catalogs, bibliographies and messy references as Spark jobs."""
