"""kbspark: Spark jobs for building, searching and measuring a document knowledge base."""
