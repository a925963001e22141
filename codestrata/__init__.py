"""codestrata: source-code evidence as Spark tables, and relational operators over them."""
