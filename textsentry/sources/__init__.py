"""Rule catalogues, file trees, charset decoding and chunking."""
