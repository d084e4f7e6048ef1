"""PDF files: objects, filters, encryption, text, structure, and writing. The parsing is plain Python, run once per file by a task."""
