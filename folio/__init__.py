"""folio: a document-catalogue engine expressed as Spark DataFrame plans."""
