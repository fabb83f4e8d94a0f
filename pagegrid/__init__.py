"""Web-data tables on Spark: pages to rows, row tables, control tables and event metrics."""
