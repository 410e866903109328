"""Column expressions: ids from names, tokens, md5 keys, array math."""
