"""Training-data operators over documents and web pages. Nothing else in leafwise imports this subpackage."""
