"""Column functions: text, numerals and titles. All of them are built-in expressions; none is a UDF."""
