"""Projects and the batch stages that turn frames into tables."""
