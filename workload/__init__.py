"""Series made from the given tables, and the queries and SQL that check the library on them."""
