"""Training-data operators: ten stand-alone components over documents, pages and conversations."""
