"""vellumlake: markdown-document collections and corpus preparation on Spark."""
