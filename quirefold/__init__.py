"""quirefold: document-token analytics on Spark."""
