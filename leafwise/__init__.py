"""leafwise: JSON, Protobuf and flat key-value documents as Spark DataFrame columns."""
