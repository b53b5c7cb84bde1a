"""Images, OCR and captions: where records come from."""
