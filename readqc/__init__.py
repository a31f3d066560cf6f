"""Quality control, trimming and filtering of sequencing reads as DataFrame operators."""
