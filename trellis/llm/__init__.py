"""Training-data pipeline operators (thirteen stand-alone operators over documents,
pages, embeddings and conversations). Nothing else in the library imports this subpackage."""
