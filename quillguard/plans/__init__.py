"""The registered queries of the redaction engine and the SQL they are held against."""
